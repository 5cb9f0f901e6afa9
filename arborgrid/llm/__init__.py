"""Training-data operators: tokenising, splitting, packing, sampling, nearest vectors, subsets."""
