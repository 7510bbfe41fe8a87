"""The built-in functions: signatures, and their implementations over values."""
