"""Relational operators on points, paths, intervals and rasters."""
