"""Column builders (native Spark expressions) and the few Arrow-batched scalar functions."""
