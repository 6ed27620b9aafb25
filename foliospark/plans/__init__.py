"""Query catalogue of the engine."""
