"""The bitmap of keys, see granary/sieve.py."""

from granary.sieve import ROWS, maybe

__all__ = ["ROWS", "maybe"]
