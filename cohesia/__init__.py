"""Cohesia: cluster-validity analytics as DataFrame plans."""
