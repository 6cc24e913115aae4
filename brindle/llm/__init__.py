"""Training-data operators: language ID, near-duplicate joins, packing, media, mixing, chat, token files, counts, PII, quality."""
