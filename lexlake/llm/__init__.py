"""Operators for training data: packing, near-duplicates, byte-level BPE, repeated
passages, toxicity, token counts, search, secrets, language-model scores and leaks.

Nothing else in the library imports this package.
"""
