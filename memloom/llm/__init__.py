"""Operators for training data: splits, pair defects, pieces, token ids, mixes, garbled text.

Nothing outside this package imports it.
"""
