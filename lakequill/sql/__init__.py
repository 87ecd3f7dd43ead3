"""The SQL dialect: text to nodes to Spark SQL."""
