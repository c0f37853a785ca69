"""Training-data operators: search, scoring, sharding, packing, deduplication and mixing on DataFrames."""
