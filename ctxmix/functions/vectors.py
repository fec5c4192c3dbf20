"""Row-level vector similarity as native Column expressions.

For scoring pairs that are already on one row (e.g. re-scoring a stored run after
joining both vectors in). Bulk retrieval uses the blocked NumPy cells in
:mod:`ctxmix.operators.retrieval`; these expressions are its row-wise counterpart
and stay inside whole-stage codegen (``zip_with`` + ``aggregate``, summed in double).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of element-wise products (double precision)."""
    prod = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def score_or_floor(score, floor: float = -1.0) -> Column:
    """an undefined similarity (NaN or null) becomes ``floor``."""
    s = _col(score)
    return F.when(s.isNull() | F.isnan(s), F.lit(floor)).otherwise(s)


def cosine(a, b, floor: float | None = -1.0) -> Column:
    """dot / (|a| |b|); a zero vector gives ``floor`` (or null when ``floor`` is None)."""
    raw = F.try_divide(dot(a, b), norm(a) * norm(b))
    return raw if floor is None else score_or_floor(raw, floor)


def similarity(a, b, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")
