"""Column functions over labels and names."""
