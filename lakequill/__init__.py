"""A SQL and data-processing engine on PySpark."""
