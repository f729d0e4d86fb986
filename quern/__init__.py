"""A Spark-native engine for searching document collections and evaluating the searches."""
