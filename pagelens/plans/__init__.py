"""Derived tables, registered queries and their reference SQL."""
