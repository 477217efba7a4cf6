"""Training-data operators: text cleaning, deduplication, classification, search and tokenisation."""
