"""Column builders: aggregates, histogram percentiles, windows and scalars."""
