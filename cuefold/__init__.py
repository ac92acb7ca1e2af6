"""cuefold: timed-text analytics on PySpark."""
