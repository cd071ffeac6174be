"""Per-dimension mean and population std of vector columns (scaler fit)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, vec: str = "embedding", by=()) -> DataFrame:
    """One aggregation (partial per task, merged after the shuffle) per group:
    ``mean``, ``scale`` (population std with 0 -> 1, as a standard scaler does) and ``n``.

    ``Summarizer`` reports the sample variance; it is rescaled by ``(n-1)/n``.
    Spark's ``ml.feature.StandardScaler`` is not used: it divides by the
    sample std and maps constant columns to 0.
    """
    summ = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec))).alias("_s")
    agg = df.groupBy(*by).agg(summ) if by else df.agg(summ)
    n = F.col("_s.count")
    ratio = F.when(n > 1, (n - 1).cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    std = F.transform(vector_to_array(F.col("_s.variance")), lambda v: F.sqrt(F.greatest(v * ratio, F.lit(0.0))))
    scale = F.transform(std, lambda s: F.when(s == 0.0, F.lit(1.0)).otherwise(s))
    return agg.select(*by, vector_to_array(F.col("_s.mean")).alias("mean"), std.alias("std"),
                      scale.alias("scale"), n.alias("n"))
