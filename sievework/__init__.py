"""sievework: a Spark-native analytics engine for source-code corpora."""

__version__ = "0.1.0"
