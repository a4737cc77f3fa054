"""Connected components, as loomgraph.operators.components has them."""

from loomgraph.operators.components import HOT, components

__all__ = ["HOT", "components"]
