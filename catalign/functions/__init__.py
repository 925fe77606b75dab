"""Column expressions: text rule and rendering, projections, arrays, row-wise cosine."""
