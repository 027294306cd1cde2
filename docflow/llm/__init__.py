"""Training-data operators: counting, deduplication, filtering, extraction, mixing, sharding."""
