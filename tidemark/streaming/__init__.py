"""Intentionally empty: every operator in scope is a batch operator, so there is nothing to stream."""
