"""Job-application analytics on Spark: import, redact, upsert, browse and count candidates."""
