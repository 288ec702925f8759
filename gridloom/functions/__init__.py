"""Column expressions: binning, angles, plane geometry, and aggregates built on them."""
