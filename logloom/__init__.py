"""Observability and security analytics as composable PySpark DataFrame operators."""
