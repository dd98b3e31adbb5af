"""Transcript scoring, curation and history analytics as Spark jobs."""
