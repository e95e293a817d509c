"""Training-data operators: ten large-corpus operations and their queries."""
