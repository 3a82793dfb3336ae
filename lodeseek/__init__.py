"""lodeseek: a Spark-native engine for hybrid text and code retrieval."""

__version__ = "0.1.0"
