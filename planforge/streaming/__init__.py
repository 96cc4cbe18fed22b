"""Continuous collection of executions."""
