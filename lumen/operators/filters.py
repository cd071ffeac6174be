"""Row filters and existence checks (S1 preparation, F1-F5, L1, J2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions.paths import patient_num, short_from_patient
from lumen.functions.text import full_report, normalize_text, prompt_from_indication

REPORT_TEXT_COLS = ["findings", "impression", "indication"]


def non_empty_reports(df: DataFrame) -> DataFrame:
    """keep rows whose findings or impression is non-empty (after T1)."""
    return df.where((F.length("findings") > 0) | (F.length("impression") > 0))


def first_n(df: DataFrame, order_by, n: int) -> DataFrame:
    """L1: first ``n`` rows by an explicit order key; ``n <= 0`` keeps everything.

    ``orderBy(...).limit(n)`` plans as a distributed top-k (each partition keeps
    its best ``n``), never a global sort or a bare nondeterministic ``limit``.
    """
    if n is None or n <= 0:
        return df
    return df.orderBy(*([order_by] if isinstance(order_by, (str, Column)) else order_by)).limit(n)


def prepare_studies(df: DataFrame, max_samples: int = -1, order_by: str = "study_id") -> DataFrame:
    """Normalise report text, keep rows with any report text, optional first-N cap,
    then derive the reference report (T2) and the prompt (T3)."""
    df = normalize_text(df, REPORT_TEXT_COLS)
    df = first_n(non_empty_reports(df), order_by, max_samples)
    return df.withColumn("full_gt", full_report("findings", "impression")) \
             .withColumn("prompt", prompt_from_indication("indication"))


def patient_range(df: DataFrame, lower: int, upper: int, path_col: str = "path") -> DataFrame:
    """S3/F2: derive ``patient_num`` and the short key, keep ``lower <= patient_num <= upper``.

    A null patient number is dropped (``between`` on null is not true), as in the reference.
    """
    if lower > upper:
        raise ValueError(f"lower bound {lower} is greater than upper bound {upper}")
    return (df.withColumn("patient_num", patient_num(path_col))
              .withColumn("path_short", short_from_patient(path_col))
              .where(F.col("patient_num").between(lower, upper)))


FAIL_NOT_FOUND = "file_not_found"
FAIL_OPEN = "image_open_error"
FAIL_EMBED = "embedding_error"


def split_existing(items: DataFrame, listing: DataFrame, key: str = "path",
                   decodable: str | None = "decodable") -> DataFrame:
    """Attach ``status`` / ``reason`` from a file listing.

    One left join (AQE picks broadcast when the listing turns out small at run
    time); missing files become ``file_not_found`` rows and undecodable ones
    ``image_open_error`` rows instead of silently vanishing.
    """
    lst = listing.select(F.col(key).alias("_lkey"),
                         (F.col(decodable) if decodable else F.lit(1)).alias("_dec"),
                         F.lit(True).alias("_seen"))
    j = items.join(lst, items[key] == lst["_lkey"], "left")
    reason = (F.when(F.col("_seen").isNull(), F.lit(FAIL_NOT_FOUND))
              .when(F.col("_dec") == 0, F.lit(FAIL_OPEN)))
    return (j.withColumn("reason", reason)
             .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
             .drop("_lkey", "_dec", "_seen"))
