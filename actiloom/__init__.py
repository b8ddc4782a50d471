"""Agent activity analytics expressed as Spark DataFrame operators."""
