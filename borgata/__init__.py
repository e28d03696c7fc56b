"""Listings and price analytics on Spark.

``functions``  Column -> Column expressions (no Python in the hot path)
``operators``  DataFrame -> DataFrame jobs
``sources``    readers, writers, catalog, load reports
``streaming``  Structured Streaming jobs
``plans``      the registered queries and their SQL counterparts
"""
