"""Training-data operators: quality, dedup, formatting, decontamination, URL, PII, LM scores, encoding, language."""
