"""Column -> Column building blocks."""
from . import arrays, hashing, signals, text  # noqa: F401
