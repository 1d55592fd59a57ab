"""Training-data operators: near-dedup, mixing, chat parsing, quality, packing, language, line dedup, toxicity, sharding."""
