"""Training-data operators: deduplication, privacy, language, quality, tokens and contamination."""
