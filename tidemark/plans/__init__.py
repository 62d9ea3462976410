"""Registered queries: operators wired to the given tables, with an independent SQL text for each."""
