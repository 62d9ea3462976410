"""Operators for preparing training text: deduplication, decontamination, sharding, packing, archives, language ID."""
