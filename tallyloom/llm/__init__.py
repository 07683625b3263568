"""Training-data operators: fingerprints, token counts, near-duplicates, filters, formatting, mixing, encoding.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only where it is present.
"""
