"""Phrase-frequency analytics on Spark."""
