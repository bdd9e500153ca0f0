"""strata: a Spark-native medallion pipeline.

Bronze tables ingest CSV drops append-only with Structured Streaming, a silver
table rolls orders up per customer, checks and run gates summarise the result.
Everything is DataFrame / SQL / Structured Streaming code planned by Catalyst.
"""

__version__ = "0.1.0"
