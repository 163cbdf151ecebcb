"""How far one tensor may slide over another that is padded with zeros; the sliding itself is in the numpy kernels."""

from __future__ import annotations

import math


def padding(length: int, min_overlap: float, rounding: str = "ceil") -> int:
    """Positions added on each side; alignments round up, neighbour searches down."""
    return int(math.ceil(length * (1 - min_overlap)) if rounding == "ceil" else length * (1 - min_overlap))
