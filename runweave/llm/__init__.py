"""Training-data operators: deduplication, filtering, packing, mixing and archives."""
