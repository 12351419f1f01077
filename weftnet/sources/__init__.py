"""Readers and writers of networks, and tensors from tables."""
