"""Operators used to prepare training data. Nothing outside this subpackage imports it."""
