"""Training-data operators: extraction, filters, scoring, near-duplicate joins, mixing, packing, search."""
