"""Training-data operators: encoding, language, duplicates, filters, shards, media.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries only when it is there.
"""
