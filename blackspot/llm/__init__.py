"""Operators for preparing training text at scale, their queries and SQL."""
