"""Tensors that grow by a stream of entries."""
