"""Operators for preparing large training corpora. Nothing outside this subpackage imports it."""
