"""lodestream: Spark-native analytics for scientific runs, series and text corpora."""
