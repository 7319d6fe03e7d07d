"""srcgraph: source-code graphs of many repositories, built with Spark DataFrames."""
from .operators.graph import Graph  # noqa: F401
from .plans.analyze import build_graph  # noqa: F401

__all__ = ["Graph", "build_graph"]
