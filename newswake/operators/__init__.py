"""Relational operators over posts, events and terms."""
