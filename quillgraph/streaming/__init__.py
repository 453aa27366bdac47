"""Streams of the run log."""
