"""Texts that keep arriving."""
