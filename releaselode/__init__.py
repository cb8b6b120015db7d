"""Release-change analytics on Spark."""
