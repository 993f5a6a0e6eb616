"""Operators that prepare training data for language models, each one a set of Spark jobs."""
