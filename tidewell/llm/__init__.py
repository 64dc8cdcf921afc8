"""Operators on texts and large numeric columns for training-data pipelines.  Nothing else in the library imports this."""
