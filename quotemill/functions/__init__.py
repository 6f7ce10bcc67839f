"""Column expressions without joins or aggregates."""
