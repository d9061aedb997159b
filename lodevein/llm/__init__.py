"""Operators for preparing training corpora.  Nothing outside this subpackage imports it."""
