"""Training-data operators: quality, toxicity, privacy, extraction, counting, deduplication, scans, mixing, decontamination."""
