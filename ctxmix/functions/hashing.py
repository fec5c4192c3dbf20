"""Keyed hashes used for reproducible draws and shuffles.

The same expression is portable to DuckDB as
``('0x' || substr(md5(concat_ws('|', ...)), 1, 15))::BIGINT``, which is how the
oracle SQL reproduces our random choices exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(*parts) -> Column:
    """Non-negative 60-bit integer from md5 over ``'|'``-joined parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sql_keyed_hash(*parts: str) -> str:
    """DuckDB text of :func:`keyed_hash` for the oracle queries."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"
