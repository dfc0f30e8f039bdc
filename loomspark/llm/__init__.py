"""Corpus preparation for language-model training."""
