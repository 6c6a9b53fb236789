"""Training-data operators: text scoring, fingerprints, token files, packing,
sharding, similarity joins, extraction, search and mixing."""
