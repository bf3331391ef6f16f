"""Source- and text-similarity analytics as composable PySpark DataFrame operators."""
