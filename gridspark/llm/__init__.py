"""Operators for the preparation of training text, with their queries; nothing else in the library imports them."""
