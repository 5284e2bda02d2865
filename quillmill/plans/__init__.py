"""Registered queries and shared plans."""
