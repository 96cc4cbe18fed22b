"""Learned cardinality and plan-choice models, in numpy and Spark ML."""
