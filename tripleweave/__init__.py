"""tripleweave: knowledge-graph alignment as PySpark DataFrame programs."""

from tripleweave.config import Thresholds

__all__ = ["Thresholds"]
