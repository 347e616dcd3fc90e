"""Security-findings analytics and training-data operators on PySpark."""
