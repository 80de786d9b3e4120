"""The same results in another engine, and the comparison."""
