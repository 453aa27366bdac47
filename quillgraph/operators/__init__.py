"""Relational operators of the evidence graph."""
