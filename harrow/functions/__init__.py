"""Column functions and the Python functions behind UDFs."""
