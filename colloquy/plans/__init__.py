"""Derived tables and the registered queries."""
