"""Content-pattern analytics on PySpark."""
