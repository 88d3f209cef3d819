"""Column functions and small scalar helpers."""
