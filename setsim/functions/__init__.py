"""Column expressions: similarity bounds, bit signatures, option values."""
