"""Operators that prepare large training collections. Nothing else in the library imports this package."""
