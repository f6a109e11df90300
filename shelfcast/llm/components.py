"""Connected components of a graph held as a table of edges; the work is a general helper of the library."""

from shelfcast.operators.components import connected

__all__ = ["connected"]
