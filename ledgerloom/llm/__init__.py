"""Training-data operators: media, archives, fingerprints, packing, filters, deduplication.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
