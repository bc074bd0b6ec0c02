"""Column builders without UDFs."""
