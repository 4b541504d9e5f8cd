"""Episode-to-impact analytics as composable PySpark DataFrame operators."""
