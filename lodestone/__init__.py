"""A PySpark-native engine for verifiable language-model training corpora."""

__version__ = "0.1.0"
