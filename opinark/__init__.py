"""opinark: Spark-first operators for mining opinions from product reviews."""

__version__ = "0.1.0"
