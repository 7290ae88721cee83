"""Training-data operators: deduplication, scoring, tokenising, mixing and fingerprints of documents."""
