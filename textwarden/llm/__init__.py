"""Training-data operators: tokenizing, de-duplication, filtering, search."""
