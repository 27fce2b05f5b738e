"""Site-quality analytics as Spark DataFrame operators."""
