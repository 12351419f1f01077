"""Quantum circuits as tensor networks."""
