"""Entities read from the tables."""
