"""Training-data operators: extraction, dedup, filtering, tokenising.  Nothing else in the library imports this."""
