"""Operators that prepare very large text corpora for training. Nothing outside this subpackage imports it."""
