"""Training-data operators: deduplication, scoring, scanning, packing and encoding of text tables."""
