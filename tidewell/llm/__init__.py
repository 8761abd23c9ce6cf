"""Training-data operators: formatting, scoring, deduplication, tokenisation and sharding of text corpora."""
