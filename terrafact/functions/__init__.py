"""Column expressions: typed coercions, rules, keys and place/time helpers."""
