"""Advertising-report analytics as Spark DataFrame functions."""
