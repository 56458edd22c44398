"""Tutoring-programme analytics as Spark DataFrame operators."""
