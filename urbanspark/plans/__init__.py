"""Registered queries, each with its SQL oracle."""
