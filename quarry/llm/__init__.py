"""Operators for preparing language-model training corpora at scale.

Nothing else in the library imports this subpackage.
"""
