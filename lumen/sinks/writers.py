"""Sinks: run tables, models table, embeddings, manifests, upsert (K1-K7, K9)."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.paths import run_path
from lumen.functions.vectors import assert_uniform_dim, to_wide

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("started_at", T.TimestampType()), T.StructField("runtime_s", T.DoubleType()),
    T.StructField("evaluation", T.StringType()),
])


def write_results(results: DataFrame, base: str, task: str, run_date: str,
                  fmt: str = "parquet", mode: str = "overwrite", status_col: str | None = None):
    """Results under ``{base}/{task}/run_date=MM-dd`` (one path rule
    for every run). Row counts (and ok/failed counts when ``status_col`` is
    given) are observed during the write itself -- no second pass over the
    results. Returns ``(path, counts)``."""
    from pyspark.sql import Observation

    path = run_path(base, run_date, task)
    obs = Observation(f"write_{task}")
    metrics = [F.count(F.lit(1)).alias("rows")]
    if status_col:
        metrics += [F.count(F.when(F.col(status_col) == "ok", 1)).alias("ok"),
                    F.count(F.when(F.col(status_col) != "ok", 1)).alias("failed")]
    writer = results.observe(obs, *metrics).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path, dict(obs.get)


def run_row(spark: SparkSession, task: str, params: dict, started: float,
            run_id: str | None = None, evaluation: dict | None = None) -> DataFrame:
    """K1/K5/K6 metadata as one ``runs`` row (``start_time`` stays out of params)."""
    row = (run_id or uuid.uuid4().hex, task, {k: json.dumps(v) for k, v in params.items() if k != "start_time"},
           None, round(time.time() - started, 2), json.dumps(evaluation) if evaluation is not None else None)
    return spark.createDataFrame([row], RUN_SCHEMA).withColumn(
        "started_at", F.timestamp_seconds(F.lit(started)))


def write_embeddings(df: DataFrame, path: str, wide: bool = False, vec: str = "embedding") -> None:
    """K2: vectors as ``array<float>`` (or ``emb_%04d`` columns); the width must be uniform."""
    ok = df.where(F.col("status") == "ok") if "status" in df.columns else df
    if wide:
        ok = to_wide(ok, assert_uniform_dim(ok, vec), vec)
    ok.write.mode("overwrite").parquet(path)


def manifest(results: DataFrame, patient_col: str = "patient_num") -> DataFrame:
    """K3: counts per (status, reason): images and distinct patients."""
    return results.groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("n_images"), F.countDistinct(patient_col).alias("n_patients"))


def upsert(old: DataFrame, new: DataFrame, key, allow_create: bool = False) -> DataFrame:
    """K7: update the columns that ``new`` names, by key; all other columns keep their values.

    A null in ``new`` leaves the old value. Raises when a new key has no
    existing row (unless ``allow_create``: the row is added with nulls
    elsewhere) and when ``new`` holds a key twice.
    """
    keys = [key] if isinstance(key, str) else list(key)
    twice = new.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("upsert rows repeat a key")
    if not allow_create:
        orphans = new.select(*keys).join(old.select(*keys), keys, "left_anti")
        if not orphans.isEmpty():
            raise FileNotFoundError("upsert target rows do not exist for some keys")
    named = [c for c in new.columns if c not in keys]
    update = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in named])
    joined = old.join(update, keys, "full" if allow_create else "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in named else F.col(c) for c in old.columns])


def write_models(models: DataFrame, path: str) -> None:
    """K4: the models table, partitioned by condition."""
    models.write.mode("overwrite").partitionBy("condition").parquet(path)
