"""Training-data operators: sharding, near and exact deduplication, URL and quality filters, archives, mixing,
token counts and benchmark decontamination.  Nothing else in the library imports this subpackage."""
