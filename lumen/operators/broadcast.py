"""Joins against a small side, broadcast only behind a size check.

Every small side joined here carries a **bound**: a row count the caller
proves (from a literal list, a sizing pass, or by counting a table it has
just materialised) and a row width. With rows times width under
``MAX_BROADCAST_BYTES`` the small side is broadcast by hint -- which also keeps the planner from broadcasting the
*big* side when its size estimate is wrong (estimates do not scale through
``explode``/``inline``; a 10M-row score table was once estimated smaller than
a 6-row cut-point table). Above the bound, or without one, the join is a
plain shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest bounds that may be broadcast by hint.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               bound: int | None = None, row_bytes: int = 256) -> DataFrame:
    """Join ``big`` with a side expected to be small.

    ``bound`` is a proven maximum row count of ``small`` and ``row_bytes`` the
    width of its rows; under ``MAX_BROADCAST_ROWS`` and ``MAX_BROADCAST_BYTES``
    the side is broadcast by hint. Otherwise the join is a plain shuffle join.
    """
    if bound is not None and bound <= MAX_BROADCAST_ROWS and bound * row_bytes <= MAX_BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_hash"), on, how)


def materialize_small(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint a small derived table into the shared folder and count it
    (the count reads the checkpoint, not the lineage). Returns ``(df, rows)``."""
    from lumen.session import cut_lineage
    m = cut_lineage(df)
    return m, m.count()
