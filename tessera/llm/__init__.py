"""Training-data operators: sharding, deduplication, packing, filters and tokenization."""
