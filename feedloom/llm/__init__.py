"""Training-data operators: scoring, cleaning, deduplication, formatting and packing of text corpora."""
