"""Discovery of relaxed functional dependencies on Spark.

A rule says: rows whose left-hand attributes differ by at most their thresholds have right-hand values that differ by at
most theirs, but for a bounded share of row pairs.
"""

from .spec import Attribute, thresholds_for

__all__ = ["Attribute", "thresholds_for"]
