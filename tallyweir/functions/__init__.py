"""Column expressions: casting, keys, masks, scoring and validity rules."""
