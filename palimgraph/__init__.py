"""A Spark-native engine for the edit history of versioned knowledge graphs."""
