"""Label tables as the flows read them (S2, S3, S4): columns checked, cap in file order, strict labels counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumen.functions.paths import drop_two_dirs, resolve_path
from lumen.operators.filters import patient_range
from lumen.session import cut_lineage
from lumen.sources.tables import POSITION, read_label_csv, require_columns

#: The range of patient numbers.
FIRST_PATIENT, LAST_PATIENT = 1, 8528


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """L1: the first ``n`` rows in file order (name of the file, place in it); ``n <= 0`` keeps all.

    ``df`` comes from ``read_label_csv(..., position=True)``. A row's place is
    the start of its block and its running number in the task that reads the
    block, so the order does not depend on how files are split or packed. Every
    task keeps its first ``n`` rows; nothing is sorted as a whole.
    """
    if n > 0:
        df = df.orderBy(*POSITION).limit(n)
    return df.drop(*POSITION)


def load_classification(spark: SparkSession, path: str, conditions, max_samples: int = -1, strict: bool = True,
                        path_col: str = "Path") -> DataFrame:
    """Label CSV for classification, its required columns, the first ``max_samples`` rows, labels as integers.

    A label that is no integer (missing, not a number, a fraction) is an
    offender. Offenders are counted per condition in the pass that reads and
    stores the rows; with ``strict`` any of them raises with the counts, else
    they are null. -1 stays.
    """
    conditions = list(conditions)
    df = read_label_csv(spark, path, position=True)
    require_columns(df, [path_col, *conditions], "label table")
    df = first_rows(df, max_samples)
    others = [c for c in df.columns if c not in conditions]
    number = {c: F.col(f"`{c}`").try_cast("double") for c in conditions}
    label = {c: F.when(~F.isnan(x) & (x == F.floor(x)), x.try_cast("int")) for c, x in number.items()}
    df = df.select(*[F.col(f"`{c}`") for c in others], *[label[c].alias(c) for c in conditions])
    seen = Observation()
    df = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"),
                                *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"bad{i}") for i, c in enumerate(conditions)]))
    bad = {c: seen.get[f"bad{i}"] for i, c in enumerate(conditions) if seen.get[f"bad{i}"]}
    if strict and bad:
        raise ValueError(f"labels that are no integers, of {seen.get['rows']} rows: "
                         + ", ".join(f"{c}: {n}" for c, n in bad.items()))
    return df


def load_embedding_items(spark: SparkSession, path: str, image_dir: str = "", lower: int = FIRST_PATIENT,
                         upper: int = LAST_PATIENT, path_col: str = "Path") -> DataFrame:
    """S3: label CSV for embedding: patient number, short key and file of every row in the patient range."""
    df = read_label_csv(spark, path)
    require_columns(df, [path_col], "label table")
    df = patient_range(df, lower, upper, path_col)
    key = F.coalesce("path_short", path_col)
    return df.withColumn("source_image_path", F.col(path_col)).withColumn(
        "resolved_image_path", resolve_path(key, image_dir) if image_dir else key)


def load_evaluation_labels(spark: SparkSession, path: str, schema: str | None = None, path_col: str = "Path") -> DataFrame:
    """Label CSV for evaluation, with the key that drops the first two folders."""
    df = read_label_csv(spark, path, schema)
    require_columns(df, [path_col], "label table")
    return df.withColumn("path_short", drop_two_dirs(path_col))
