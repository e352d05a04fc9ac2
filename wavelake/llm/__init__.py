"""Training-data operators: each module holds one operator over document tables."""
