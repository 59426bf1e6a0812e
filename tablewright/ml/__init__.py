"""Machine learning on tables with pyspark.ml."""
