"""Property-graph inventory quality on Spark.

Every operator is a function from DataFrames (``vertices``, ``edges``,
``node_types``, ``edge_rules``) to DataFrames.
"""

from graphwarden.model import Graph

__all__ = ["Graph"]
