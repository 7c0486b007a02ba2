"""Operators on graphs, vectors, users, triples and texts."""
