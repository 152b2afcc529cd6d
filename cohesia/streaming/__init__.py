"""Incremental validity statistics over streams."""
