"""Distances, kernels, linear algebra and reductions."""
