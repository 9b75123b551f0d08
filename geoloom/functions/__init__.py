"""Column expressions for coordinates, geometry and rasters. All stay inside generated code."""
