"""Terrain analytics on Spark: rasters as cell tables, map algebra as plans."""
