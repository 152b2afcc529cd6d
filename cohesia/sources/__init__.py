"""Readers, generators and report sinks."""
