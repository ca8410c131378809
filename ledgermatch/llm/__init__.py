"""Operators for preparing training text, and the queries that apply them."""
