"""Spark jobs for digital-phenotyping data: sensors, questionnaires, places, models."""
