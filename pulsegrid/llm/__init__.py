"""Training-data operators: dedup, quality, tokens, packing, secrets, language, pieces."""
