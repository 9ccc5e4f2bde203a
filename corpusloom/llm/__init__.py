"""Training-data operators: tokenising, deduplication, filters, packing, formatting, sharding and counts."""
