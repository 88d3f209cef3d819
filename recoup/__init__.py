"""Portfolio recovery analytics as Spark DataFrame operators."""
