"""Training-data operators: dedup, language ID, mixing, quality, tokens, LM scoring, ANN, WARC, packing."""
