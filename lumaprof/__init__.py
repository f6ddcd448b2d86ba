"""Profile analytics as composable PySpark DataFrame operators."""
