"""Training-data operators: sharding, deduplication, mixing, archives, language, extraction, decontamination."""
