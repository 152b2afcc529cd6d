"""Validity indices and the expressions they are made of."""
