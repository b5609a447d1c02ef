"""Connected components of a link table, as the core library finds them."""

from __future__ import annotations

from lumenfold.operators.components import connected_components

__all__ = ["connected_components"]
