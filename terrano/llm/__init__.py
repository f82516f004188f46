"""Training-data operators: dedup, decontamination, packing, PII, quality and their relatives."""
