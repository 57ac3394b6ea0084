"""pagemill: Spark-native analytics over captured web pages."""

from .ship import ship

__all__ = ["ship"]
