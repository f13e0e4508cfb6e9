"""Ordinal prediction from text and photo vectors, as Spark DataFrame plans."""
