"""Spatial instance matching and its evaluation as Spark plans."""
