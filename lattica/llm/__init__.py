"""Training-data operators on Spark: extraction, filtering, deduplication, packing and output."""
