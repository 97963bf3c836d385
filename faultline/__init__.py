"""Log-failure diagnosis as Spark DataFrame operators."""
