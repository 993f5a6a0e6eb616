"""Spark-first analytics operators: batch, streaming and data-source building blocks."""
