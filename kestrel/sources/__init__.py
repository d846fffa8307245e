"""Readers and writers: driver tables, delimited files, batches, result tables."""
