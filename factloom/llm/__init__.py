"""Training-data operators: language, duplicates, licences, fingerprints,
shards, decontamination, repeated passages, tokens, personal data, quality."""
