"""Operators for preparing training data at scale: tokens, archives, packing, privacy, media, deduplication,
classification and nearest neighbours. Nothing else in the library imports this subpackage."""
