"""Operators for building training corpora on Spark.

Each module holds one operator; :mod:`sparkloom.llm.queries` registers the
thin queries.  Nothing outside this package imports it.
"""
