"""Operators on texts: one DataFrame in, one DataFrame out."""
