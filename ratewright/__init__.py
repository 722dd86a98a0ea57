"""A Spark engine for filing quality, rate benchmarks and training-data preparation."""
