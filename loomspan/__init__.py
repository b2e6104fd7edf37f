"""loomspan: a Spark-native engine for building, searching and auditing corpora of cited passages."""
