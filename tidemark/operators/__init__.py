"""Operators on long panels, each a DataFrame plan."""
