"""feedline: posting feeds, lead crawls and geo points as Spark DataFrame jobs.

Layout
------
functions/   Column-valued scalar helpers (fingerprints, text parsing, dates, salary, years).
operators/   DataFrame -> DataFrame operators (predicates, dedup, joins, digest, language).
sources/     Readers that turn landed payloads / tables into the POSTING and LEAD schemas.
plans/       End-to-end flows (postings run, leads run) and the append-only state tables.
streaming/   Structured Streaming twins of the flows (availableNow micro-batches).
"""

__version__ = "0.1.0"
