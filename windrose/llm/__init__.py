"""Operators for training-data pipelines: near duplicates, quality, tokenizers, archives, language models, privacy, toxicity."""
