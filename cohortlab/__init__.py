"""Experimentation analytics on Spark."""
