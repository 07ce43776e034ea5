"""Operators on training-data tables. Nothing outside this subpackage imports it."""
