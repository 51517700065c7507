"""Training-data operators: extraction, mixing, formatting, sharding, packing, filtering, dedup and search."""
