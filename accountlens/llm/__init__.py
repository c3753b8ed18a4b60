"""Operators that prepare a training corpus. Nothing else in the package imports them."""
