"""Quernstone: a PySpark engine for curating text collections."""
