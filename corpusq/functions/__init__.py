"""Column functions on text, paths, vectors and JSON."""
