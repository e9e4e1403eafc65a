"""Lodestone: multiresolution-geometry analytics on PySpark."""
