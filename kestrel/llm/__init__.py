"""Operators of a training-data pipeline: tokenisation, de-duplication, filters, classifier.

Each module holds one operator (a function from DataFrames to a DataFrame); ``queries``
binds them to the driver tables. Nothing outside this package imports it.
"""
