"""Readers of single documents: bytes or text in, Markdown out. Each is a pure function, run in Arrow batches."""
