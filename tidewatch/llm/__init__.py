"""Training-data operators: filters, de-duplication, tokenising and archives over whole document tables."""
