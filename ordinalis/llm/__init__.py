"""Operators for large collections of training records. Nothing outside this subpackage imports it."""
