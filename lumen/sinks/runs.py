"""Run records (K1, K5, K6): a run is committed by one row, written last.

Layout below a base folder::

    results/task=<task>/run_id=<id>/    result rows
    <table>/run_id=<id>/                further tables of a run (models, join info)
    runs/run_id=<id>/                   the run's row: the commit
    evaluations/run_id=<id>/name=<n>/   evaluations added to a run later

Every folder belongs to one run, so writing a run again under its id replaces
its own folders and touches no other run, and writers of different runs never
meet. Results are invisible to readers until the row is there; a run that
breaks before leaves none. Row counts are observed while results are written.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("evaluation", T.StringType()),
    T.StructField("started_at", T.TimestampType()), T.StructField("runtime_s", T.DoubleType())])
EVALUATIONS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("name", T.StringType()),
                            T.StructField("evaluation", T.StringType()), T.StructField("evaluated_at", T.TimestampType())])


def _folder(base: str, table: str, run_id: str) -> str:
    if not run_id or "/" in run_id or "=" in run_id:
        raise ValueError(f"not a run id: {run_id!r}")
    return f"{base.rstrip('/')}/{table}/run_id={run_id}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass
class Run:
    """A run being written. ``add`` writes tables; ``commit`` makes them visible."""

    spark: SparkSession
    base: str
    task: str
    run_id: str
    params: dict
    started: float = field(default_factory=time.time)
    counts: dict = field(default_factory=dict)
    tables: list = field(default_factory=list)

    def add(self, table: str, rows: DataFrame, status: str | None = None) -> DataFrame:
        """Write ``rows`` as a table of this run, count them in the same pass, and return what was written."""
        from pyspark.sql import Observation

        path = _folder(self.base, f"{table}/task={self.task}" if table == "results" else table, self.run_id)
        seen = Observation(f"{table}-{self.run_id}")
        metrics = [F.count(F.lit(1)).alias("rows")]
        if status:
            metrics += [F.count(F.when(F.col(status) == "ok", 1)).alias("ok"), F.count(F.when(F.col(status) != "ok", 1)).alias("failed")]
        rows.observe(seen, *metrics).write.mode("overwrite").parquet(path)
        self.counts |= {f"{table}.{k}": int(v) for k, v in seen.get.items()}
        self.tables.append(table)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, evaluation: dict | None = None) -> DataFrame:
        """Append the run's row; ``start_time`` stays out of the parameters."""
        row = (self.run_id, self.task, {k: json.dumps(v, default=str) for k, v in self.params.items() if k != "start_time"}, self.counts,
               self.tables, None if evaluation is None else json.dumps(evaluation, default=str, sort_keys=True), None,
               round(time.time() - self.started, 2))
        df = self.spark.createDataFrame([row], RUNS).withColumn("started_at", F.timestamp_seconds(F.lit(self.started)))
        df.select(RUNS.names).coalesce(1).write.mode("overwrite").parquet(_folder(self.base, "runs", self.run_id))
        return read_run(self.spark, self.base, self.run_id)


def read_runs(spark: SparkSession, base: str) -> DataFrame:
    """All committed runs (an empty table when there are none yet)."""
    path = f"{base.rstrip('/')}/runs"
    if not _exists(spark, path):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).option("recursiveFileLookup", True).parquet(path)


def read_run(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """One committed run; an error when it does not exist. Only its own folder is read."""
    path = _folder(base, "runs", run_id)
    if not _exists(spark, path + "/_SUCCESS"):
        raise FileNotFoundError(f"run {run_id!r} is not committed under {base}")
    return spark.read.schema(RUNS).parquet(path)


def read_table_of(spark: SparkSession, base: str, run_id: str, table: str = "results") -> DataFrame:
    """A table of a committed run."""
    run = read_run(spark, base, run_id).first()
    if table not in run["tables"]:
        raise FileNotFoundError(f"run {run_id!r} has no table {table!r}")
    return spark.read.parquet(_folder(base, f"{table}/task={run['task']}" if table == "results" else table, run_id))


def add_evaluation(spark: SparkSession, base: str, run_id: str, name: str, evaluation: dict) -> DataFrame:
    """K7: add or replace one named evaluation of a committed run.

    The run's row is not rewritten, so no other column can change. Writers of
    different evaluations own different folders; the same one may be repeated.
    """
    read_run(spark, base, run_id)
    if not name or "/" in name or "=" in name:
        raise ValueError(f"not an evaluation name: {name!r}")
    row = [(run_id, name, json.dumps(evaluation, default=str, sort_keys=True), None)]
    df = spark.createDataFrame(row, EVALUATIONS).withColumn("evaluated_at", F.current_timestamp())
    df.coalesce(1).write.mode("overwrite").parquet(f"{_folder(base, 'evaluations', run_id)}/name={name}")
    return read_evaluations(spark, base).where(F.col("run_id") == run_id)


def read_evaluations(spark: SparkSession, base: str) -> DataFrame:
    path = f"{base.rstrip('/')}/evaluations"
    if not _exists(spark, path):
        return spark.createDataFrame([], EVALUATIONS)
    return spark.read.schema(EVALUATIONS).option("recursiveFileLookup", True).parquet(path)


def runs_with_evaluations(spark: SparkSession, base: str) -> DataFrame:
    """Runs with ``evaluations``: a map of all that were added later, by name."""
    e = read_evaluations(spark, base).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "evaluation"))).alias("evaluations"))
    return read_runs(spark, base).join(e, "run_id", "left")


def runs_with_models(spark: SparkSession, base: str) -> DataFrame:
    """K5: one row per (run, model) of the committed training runs, without coefficients."""
    runs = read_runs(spark, base).where(F.array_contains("tables", "models"))
    path = f"{base.rstrip('/')}/models"
    if not _exists(spark, path):
        return runs.select("run_id", "task", "started_at", "runtime_s").limit(0)
    # the id comes from the folder's name as text: partition discovery would read "01" as a number
    models = (spark.read.option("recursiveFileLookup", True).parquet(path)
              .withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), "/run_id=([^/]+)/", 1)))
    keep = [c for c in models.columns if c not in ("run_id", "coef", "intercept", "mean", "scale")]
    return runs.select("run_id", "task", "started_at", "runtime_s").join(models.select("run_id", *keep), "run_id")


def patients_over_runs(spark: SparkSession, base: str) -> DataFrame:
    """A6 over runs: images and distinct patients of each run (exact) and of all committed runs together.

    The total comes from the runs' sketches (``distinct_counts``), so no run is
    read again. Its relative standard error is 1.04 / sqrt(2^SKETCH_BITS), 1.6 %.
    """
    from lumen.operators.metrics import merge_distinct_counts

    path = f"{base.rstrip('/')}/patients"
    runs = read_runs(spark, base).where(F.array_contains("tables", "patients")).select("run_id", "task")
    rows = (spark.read.option("recursiveFileLookup", True).parquet(path)
            .withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), "/run_id=([^/]+)/", 1)).join(runs, "run_id"))
    return rows.select("run_id", "task", "n_rows", "n_distinct").unionByName(
        merge_distinct_counts(rows).select(F.lit(None).cast("string").alias("run_id"), F.lit("all").alias("task"), "n_rows",
                                           F.col("n_distinct_estimate").alias("n_distinct")))
