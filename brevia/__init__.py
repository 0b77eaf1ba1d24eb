"""Spark-native reduction of documents and JSON to compact Markdown, at corpus scale."""
