"""Training-data operators: scoring, deduplication, decontamination, tokens."""
