"""Quote analytics on PySpark: every step is a DataFrame transformation."""
