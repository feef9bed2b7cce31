"""Training-data operators: language ID, token files, mixing, quality, search, packing, sharding, toxicity and near-duplicates.

Each module holds one operator with a general interface; ``queries`` holds the thin registered queries. Nothing else in
the library imports this subpackage.
"""
