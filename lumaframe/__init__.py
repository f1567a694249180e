"""Spark-first analytics for large media libraries: fingerprints, duplicate groups, text votes and file plans."""
