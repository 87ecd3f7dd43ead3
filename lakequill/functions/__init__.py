"""Functions of the dialect as Spark SQL expressions."""
