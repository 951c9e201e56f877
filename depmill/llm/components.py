"""Connected components of an edge table."""

from ..plans.components import components

__all__ = ["components"]
