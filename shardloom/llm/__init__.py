"""Training-data operators: deduplication, scoring, mixing, archives, tokenising, private data, media."""
