"""Training-data operators: scoring, sharding, mixing, formatting, quality, dedup, search, packing."""
