"""Column-level building blocks: hashing, metric formulas, scalar helpers."""
