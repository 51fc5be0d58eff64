"""Column functions: geometry on the sphere and in local planes, names, labels."""
