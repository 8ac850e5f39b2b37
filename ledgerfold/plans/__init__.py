"""Spark building blocks: plans."""
