"""See the module docstrings in this package."""
