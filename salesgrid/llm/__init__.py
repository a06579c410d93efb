"""Training-data operators (WARC derivatives, packing, toxicity, near-duplicates,
secrets, mixing, substring removal, quality rules, token files, Jaccard join).

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
