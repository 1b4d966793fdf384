"""Spark-native exploration, profiling and rewriting of Parquet datasets."""
