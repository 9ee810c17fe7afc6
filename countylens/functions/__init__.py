"""Column expressions; no plan, no action."""
