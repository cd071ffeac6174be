"""Dense-vector expressions over ``array<float|double>`` columns (T16, T17, M5, dot)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions.text import _col

# torch.nn.functional.normalize's default epsilon.
NORM_EPS = 1e-12


def sq_norm(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalize(v) -> Column:
    """``v / max(||v||, eps)`` elementwise.

    The norm is bound by an outer lambda, so it is computed once per vector and
    not once per element.
    """
    n = F.greatest(l2_norm(v), F.lit(NORM_EPS))
    return F.transform(F.array(n), lambda m: F.transform(_col(v), lambda x: x.cast("double") / m))[0]


def dot(a, b) -> Column:
    """Sum of elementwise products (arrays of equal length)."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def standardize(v, mean, scale) -> Column:
    """M5: ``(v - mean) / scale`` elementwise (scale already has 0 replaced by 1)."""
    centered = F.zip_with(_col(v), _col(mean), lambda x, m: x.cast("double") - m)
    return F.zip_with(centered, _col(scale), lambda x, s: x / s)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def wide_columns(df: DataFrame, prefix: str = "emb_") -> list[str]:
    """Discover wide vector columns by prefix, in column order."""
    return [c for c in df.columns if c.startswith(prefix)]


def to_array(df: DataFrame, prefix: str = "emb_", out: str = "embedding") -> DataFrame:
    """Wide ``emb_0000..`` columns -> one ``array<float>`` column."""
    cols = wide_columns(df, prefix)
    if not cols:
        raise ValueError(f"no vector columns starting with {prefix!r}")
    rest = [c for c in df.columns if c not in set(cols)]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in cols]).alias(out))


def to_wide(df: DataFrame, dim: int, col: str = "embedding", prefix: str = "emb_") -> DataFrame:
    """``array`` -> ``emb_%04d`` columns; ``dim`` is checked by ``assert_uniform_dim``."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.get(F.col(col), i).alias(f"{prefix}{i:04d}") for i in range(dim)])


def assert_uniform_dim(df: DataFrame, col: str = "embedding") -> int:
    """One aggregate pass: every vector must have the same length; returns it."""
    row = df.agg(F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    if row is None or row["lo"] is None:
        raise ValueError("no vectors")
    if row["lo"] != row["hi"]:
        raise ValueError(f"vector length varies between {row['lo']} and {row['hi']}")
    return int(row["lo"])
