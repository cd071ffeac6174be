"""Label projections: U-Zero, strict labels, ambiguity policy, wide <-> long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions.text import _col


def u_zero(c) -> Column:
    """Null / NaN / -1 -> 0, otherwise truncate to int (2.0 stays 2)."""
    x = _col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == -1.0), F.lit(0)).otherwise(x.cast("int"))


def strict_label(c) -> Column:
    """``int(value)``; a null label fails the task like the reference's ``int(None)``."""
    x = _col(c)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), x.cast("int")).otherwise(
        F.raise_error(F.lit("strict label: null value in label column")))


def ambiguous_to_negative(pred) -> Column:
    """-1 (ambiguous) becomes 0."""
    p = _col(pred)
    return F.when(p == -1, F.lit(0)).otherwise(p)


def to_long_labels(df: DataFrame, key_cols, conditions, value_name: str = "raw_label") -> DataFrame:
    """Wide label table -> ``(key..., condition, raw_label double)`` via ``unpivot`` (no shuffle)."""
    conditions = [c for c in conditions if c in df.columns]
    if not conditions:
        raise ValueError("none of the requested condition columns is present")
    wide = df.select(*key_cols, *[F.col(c).cast("double").alias(c) for c in conditions])
    return wide.unpivot(list(key_cols), conditions, "condition", value_name)
