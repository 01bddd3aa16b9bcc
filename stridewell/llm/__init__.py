"""Operators for large training-text collections; nothing outside this subpackage imports it."""
