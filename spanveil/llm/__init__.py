"""Operators for preparing large text corpora to train language models on."""
