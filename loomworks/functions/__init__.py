"""Column builders, and the few Arrow UDFs that need Python's grammar."""
