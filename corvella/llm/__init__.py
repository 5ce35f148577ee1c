"""Training-data operators: scoring, scanning, deduplication, indexing, packing and output."""
