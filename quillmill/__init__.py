"""A Spark-native engine for document corpora: Markdown conversion, text repair, layout, extraction and quality."""

__version__ = "0.1.0"
