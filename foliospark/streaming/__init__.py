"""Streams of files through the same kernel as batches."""
