"""Relational operators over segments, glyphs, operators and form fields."""
