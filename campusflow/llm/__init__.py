"""Training-data operators: text deduplication, filters, scans and packing."""
