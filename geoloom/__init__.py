"""Geoloom: geospatial and corpus analytics written for Spark's DataFrame engine."""
