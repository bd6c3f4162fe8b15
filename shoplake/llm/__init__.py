"""Operators for preparing training text; `queries` registers one query for each."""
