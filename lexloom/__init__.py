"""Corpus building, span annotation and scoring as Spark jobs."""
