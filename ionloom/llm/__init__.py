"""Operators for training text: leaked evaluation items, source mixing, personal data.

Nothing outside this subpackage imports it.
"""
