"""Training-data operators: cleaning, deduplicating, scoring, mixing and packing text corpora."""
