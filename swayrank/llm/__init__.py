"""Operators for preparing training corpora: cleaning, deduplication, mixing, packing, search and archives."""
