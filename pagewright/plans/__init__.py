"""Queries wired to tables, each beside its SQL."""
