"""Corpus operators for training data: formatting, filtering, deduplication, mixing, archiving and scoring."""
