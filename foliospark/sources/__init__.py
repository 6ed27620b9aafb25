"""Readers, and what they need from the cluster."""
