"""Training-data operators: archive, packing, deduplication, decontamination, scoring and extraction."""
