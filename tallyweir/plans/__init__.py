"""Silver, Gold, serving, audit and consumption plans assembled from the operators."""
