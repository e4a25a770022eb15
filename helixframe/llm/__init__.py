"""Training-data operators: deduplication, token counts, search, quality, decontamination, PII, WARC, mixing."""
