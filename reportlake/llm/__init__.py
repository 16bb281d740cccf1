"""Operators for training data: cleaning, deduplication, classification, tokens and archives."""
