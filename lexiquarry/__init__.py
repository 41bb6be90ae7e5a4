"""Corpus analytics as lazy Spark DataFrame operators."""
