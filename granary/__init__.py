"""Granary: curated-fact compilation, hybrid retrieval and guarded answers on PySpark."""
