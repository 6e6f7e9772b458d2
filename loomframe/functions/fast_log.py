"""A shifted logarithm of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import logarithm


def fast_log(x: Column | str, eps: float = 0.0, base: float = math.e) -> Column:
    """log(x + eps) to the base."""
    return logarithm(F.col(x) if isinstance(x, str) else x, base, eps)
