"""Range-adaptive point-cloud analytics as Spark DataFrame operators."""
