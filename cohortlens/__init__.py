"""cohortlens: registry data quality, snapshot reconciliation and cohort reports on Spark.

Every operator takes DataFrames and returns one lazy DataFrame built from Spark's
own expressions. No operator runs an action; results leave through ``sources.sinks``.
"""
