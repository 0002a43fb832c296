"""Evaluation analytics on Spark: plans, extraction, scoring and aggregation of generated text."""
