"""Readers, writers and the traffic views of relational tables."""
