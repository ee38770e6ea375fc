"""Training-data operators: deduplication, decontamination, scoring, mixing and sharding."""
