"""Document-navigation analytics and training-data operators on PySpark."""
