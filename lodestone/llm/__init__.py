"""Training-data operators: formatting, dedup, filtering, tokenisation and packing."""
