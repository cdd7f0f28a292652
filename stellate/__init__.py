"""Point-cloud analytics as composable Spark DataFrame operators."""
