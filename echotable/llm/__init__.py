"""Training-data operators: tokenising, near-duplicate search, packing, privacy, language."""
