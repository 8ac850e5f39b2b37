"""Spark building blocks: operators."""
