"""Training-data operators: dedup, filters, classifiers, decontamination, mixing, token counts."""
