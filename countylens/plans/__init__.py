"""Whole jobs: preparing tables, and the reports asked of them."""
