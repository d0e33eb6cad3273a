"""Operators for training data: caps, defects, overlap, leaks, splits, copies, tokens, packing, abuse.

Nothing outside this subpackage imports it.
"""
