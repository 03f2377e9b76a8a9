"""Part of passrate."""
