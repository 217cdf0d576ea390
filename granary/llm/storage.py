"""Intermediate tables and free column names, as in the rest of the library."""

from granary.storage import Scratch, fresh, shared_dir

__all__ = ["Scratch", "fresh", "shared_dir"]
