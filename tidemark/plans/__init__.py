"""Derived tables, registered queries and their independent SQL."""
