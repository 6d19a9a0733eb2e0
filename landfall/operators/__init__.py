"""Operators: joins, discards, slices and guards, aggregations, spatial grid,
smoothing, donor matching and key checks."""
