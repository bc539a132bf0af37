"""DataFrame functions that take their windows and columns as arguments."""

from .trailing import trailing, trailing_days

__all__ = ["trailing", "trailing_days"]
