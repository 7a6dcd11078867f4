"""Training-data operators: dedup, filters, scoring, packing and archives."""
