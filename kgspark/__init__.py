"""A Spark-native engine for knowledge graphs and retrieval evaluation."""
