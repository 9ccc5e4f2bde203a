"""Corpus style analytics as Spark DataFrame jobs."""
