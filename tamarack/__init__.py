"""A Spark-native engine for a compact SQL dialect over files, and operators for text corpora."""
