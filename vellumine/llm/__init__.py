"""Training-data operators: deduplication, mixing, privacy, language, archives, tokens."""
