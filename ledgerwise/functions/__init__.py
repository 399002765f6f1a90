"""Column functions of the billing library."""
