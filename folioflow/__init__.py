"""folioflow: a Spark-native document ingestion and text analytics engine."""

__version__ = "0.1.0"
