"""Spark building blocks: functions."""
