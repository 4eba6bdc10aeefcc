"""A Spark-native engine for life-cycle-assessment matrices, and operators for training data."""
