"""Operators for preparing training data: duplicates, packing, tokens, personal data, toxicity and pages."""
