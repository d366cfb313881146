"""Training-data operators: media, quality, decontamination, extraction, packing, token files, dedup, toxicity."""
