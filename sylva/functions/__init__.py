"""Part of the sylva engine."""
