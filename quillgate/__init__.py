"""A Spark-native engine that compiles document collections into verified reference bundles."""
