"""Timeline analytics on PySpark."""
