"""Expression languages compiled to Spark columns."""
