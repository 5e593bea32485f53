"""Continuous forms of the queue and of billing events."""
