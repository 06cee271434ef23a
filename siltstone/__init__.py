"""siltstone: a Spark-native engine that turns document collections and
semi-structured records into checked quantitative evidence."""

__version__ = "0.1.0"
