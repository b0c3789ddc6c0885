"""Spark-first engine for grounding, normalizing, retrieving and relating facts."""
