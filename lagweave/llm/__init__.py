"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the entry module registers its queries only
when the subpackage is present.
"""
