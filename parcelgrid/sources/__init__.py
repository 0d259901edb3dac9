"""Readers and writers: GeoJSON, WKT layers, CSV with a preamble, serving tables."""
