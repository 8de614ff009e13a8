"""Narrative and topic analytics over dated, attributed text, expressed as Spark jobs."""
