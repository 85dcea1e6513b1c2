"""siftline: Spark-native operators for large collections of files and messages."""
