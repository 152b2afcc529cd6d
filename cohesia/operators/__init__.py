"""Relational and geometric operators over point frames."""
