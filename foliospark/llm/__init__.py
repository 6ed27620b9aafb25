"""Operators of a training-data pipeline for language models. Nothing outside this package imports it."""
