"""Operators for building training data out of documents, pages and vectors, as Spark jobs.

Nothing outside this subpackage imports it.  Python inside tasks works on Arrow batches; Spark partitions, shuffles and joins.
"""
