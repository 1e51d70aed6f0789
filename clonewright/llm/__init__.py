"""Operators for building training data: near and exact copies, packing, leaks, levels.

Nothing outside this package imports it.
"""
