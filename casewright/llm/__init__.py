"""Training-data operators: deduplication, sketches, language ID, archives, packing, mixing, chat formatting."""
