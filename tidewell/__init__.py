"""A Spark-native engine for clickstream analytics, data protection and corpus processing."""
