"""Compositions of operators into the tables a user asks for."""
