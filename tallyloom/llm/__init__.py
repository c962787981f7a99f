"""Training-data operators: dedup, tokenisation, filtering, archives."""
