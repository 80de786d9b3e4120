"""DataFrame operators: cleaning, features, labels, quality, splits, metrics and models."""
