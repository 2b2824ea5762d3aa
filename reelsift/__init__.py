"""reelsift: ratings analytics on Spark DataFrames.

Sub-packages:
  sources    typed readers and sinks
  functions  Column -> Column helpers (titles, dates, labels)
  operators  DataFrame -> DataFrame building blocks (quality, joins, aggregates,
             windows, exploration, splits)
  plans      composed jobs (feature tables, source reconciliation, ML)
  streaming  Structured Streaming twins of the incremental jobs
"""

__all__ = ["session", "adapt", "schemas", "catalog"]
