"""Readers of panels: long tables of (date, asset, price) or (date, factor, value)."""
