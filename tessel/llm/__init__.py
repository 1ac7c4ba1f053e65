"""Training-data operators: deduplication, scoring, rules, decontamination, token files and packing."""
