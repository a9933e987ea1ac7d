"""Training-data pipeline operators: token files, URL and quality filters,
exact / near / substring deduplication, mixing, packing and chat formatting.

Nothing else in the library imports this subpackage.
"""
