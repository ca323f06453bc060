"""Training-data operators: deduplication, classification, scoring, sharding and tokenisation at corpus scale."""
