"""Contest analytics on Spark: entities that meet pairwise over time."""

__version__ = "0.1.0"
