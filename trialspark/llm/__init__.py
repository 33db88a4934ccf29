"""Operators of a training-data pipeline: quality, duplicates, fingerprints, personal data, tokens, mixing, toxicity, licences."""
