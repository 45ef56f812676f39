"""Operators on training text and names; nothing else in the library imports this."""
