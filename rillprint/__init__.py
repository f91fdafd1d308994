"""Content hashing and verification of raw and compressed objects as DataFrame operations."""

from .spec import M61, M127, HashSpec

__all__ = ["M61", "M127", "HashSpec"]
__version__ = "0.1.0"
