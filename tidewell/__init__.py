"""Spark-first harmonisation, retrieval and versioning of public measurement and document data."""
