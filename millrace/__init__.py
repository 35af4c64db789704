"""Snapshot-driven batch analytics on Spark: ingest, change detection, medallion tables, star schema, BI and checks."""
