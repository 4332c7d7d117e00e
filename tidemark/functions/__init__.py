"""Column expressions that Spark has no function for."""
