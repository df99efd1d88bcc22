"""Operators for preparing language-model training text.

Nothing else in minekit imports this subpackage.
"""
