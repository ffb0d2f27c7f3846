"""Training-data pipeline operators: dedup, quality, secrets, decontamination, tokens, shards."""
