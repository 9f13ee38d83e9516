"""Operators for preparing language-model training data; nothing else in loamline imports them."""
