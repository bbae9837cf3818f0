"""Operators that prepare text for language-model training.

Self-contained: the rest of the library never imports this subpackage.
"""
