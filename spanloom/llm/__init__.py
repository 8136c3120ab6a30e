"""Training-data operators: dedup, quality, chat formatting, LM scoring, decontamination, sketches, toxicity, mixing, URL lists, PII."""
