"""Operators over training corpora: cleaning, de-duplication, counting, packing, mixing.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when
the folder is there.
"""
