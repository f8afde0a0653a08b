"""Column expressions: radiometry, optics, geometry, dates."""
