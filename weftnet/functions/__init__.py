"""Column functions on labels, matrices and positions."""
