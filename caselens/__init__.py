"""Investigation analytics over event evidence, as PySpark DataFrame operators."""
