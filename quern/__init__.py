"""Dataset-shape profiling, star-schema queries and analytics as Spark DataFrame plans."""
