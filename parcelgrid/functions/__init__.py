"""Column -> Column functions: missing-value rules, units, geometry, projections."""
