"""Column-level building blocks: null-safe arithmetic and actuarial rules."""
