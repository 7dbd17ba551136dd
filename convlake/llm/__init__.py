"""Training-data operators: language id, packing, decontamination, quality, dedup, URL filters, extraction."""
