"""Column expressions: text cleaning, gates, array packing, vector arithmetic."""
