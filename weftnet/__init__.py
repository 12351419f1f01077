"""Labelled tensors and tensor networks as Spark relations."""

__version__ = "0.2.0"
