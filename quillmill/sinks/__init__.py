"""Sinks of the document corpus engine."""
