"""Raster and mask formats: codecs on bytes, and readers and writers that give long DataFrames."""
