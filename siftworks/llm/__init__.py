"""Training-data operators: quality, URL filters, WARC, near and exact dedup, search, mixing.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it is there.
"""
