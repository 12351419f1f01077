"""Tensors and networks as relations."""
