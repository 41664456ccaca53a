"""cairn: batch and streaming analytics over per-project knowledge notes, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
column expressions, joins, windows and grouped aggregates. Only the sinks
touch storage.
"""

__version__ = "0.1.0"
