"""Relational operators over tree-sequence tables."""
