"""The queries over the tables."""

from . import queries  # isort: skip
from . import over_time

__all__ = ["over_time", "queries"]
