"""Linear probes on embedding vectors: train (M3/A9/A11/J4), score (M4/M5/J7), evaluate.

Models live in a **models table** -- one row per probe with its coefficients
and the scaler it was trained with -- instead of pickled files. Scoring
joins test rows to blocks of models on ``condition`` (an equi-join against
broadcasts of bounded size), folds the scaler into the coefficients and
computes one dot product per (row, model) inside the JVM. The training
grid, with many models a condition, computes the products of a batch of rows
with all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.labels import u_zero
from lumen.functions.paths import model_name
from lumen.functions.vectors import dot, sigmoid, standardize, wide_columns
from lumen.operators.metrics import auc_by
from lumen.operators.scaler import fit_scaler
from lumen.session import checkpoint_dir, cut_lineage
from lumen.session import parallelism as task_slots
from lumen.sources.tables import require_columns

# Fixed defaults of the reference's probe training.
DEFAULT_CONDITIONS = ["Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Pleural Effusion"]
DEFAULT_C_VALUES = [0.001, 0.01, 0.1, 1.0, 10.0]

STATUS_OK = "ok"
STATUS_SKIPPED = "skipped_missing_condition_column"
STATUS_ONE_CLASS = "auc_undefined_single_class"
# Cells of the training grid that are not fitted.
STATUS_NO_ROWS = "skipped_no_training_rows"
STATUS_NOT_BINARY = "skipped_not_binary"
STATUS_SAMPLE_ONE_CLASS = "skipped_one_class"
STATUS_NO_AUC = "skipped_auc_undefined"

GRID_SCHEMA = T.StructType([
    T.StructField("condition", T.StringType()), T.StructField("sample_size", T.LongType()),
    T.StructField("c_ordinal", T.IntegerType()), T.StructField("c", T.DoubleType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("scale", T.ArrayType(T.DoubleType()))])


def long_labels(df: DataFrame, key_cols, vec: str, conditions) -> DataFrame:
    """Wide label columns -> ``(key..., vec, condition, raw_label, y)`` with U-Zero ``y``."""
    conds = [c for c in conditions if c in df.columns]
    base = df.select(*key_cols, vec, *[F.col(c).cast("double").alias(c) for c in conds])
    long = base.unpivot([*key_cols, vec], conds, "condition", "raw_label")
    return long.withColumn("y", u_zero("raw_label"))


def fold_scaler(models: DataFrame) -> DataFrame:
    """Fold ``(x - mean) / scale`` into the model: ``w' = w / scale``,
    ``b' = b - sum(w * mean / scale)`` -- one dot product per row afterwards."""
    w2 = F.zip_with("coef", "scale", lambda w, s: w / s)
    shift = F.aggregate(F.zip_with(w2, "mean", lambda w, m: w * m), F.lit(0.0), lambda a, x: a + x)
    return models.withColumn("_w", w2).withColumn("_b", F.col("intercept") - shift)


#: Models of one matrix row, and bytes of coefficients that one pass over the rows broadcasts.
BLOCK_MODELS = 64
PASS_BYTES = 32 << 20
#: Products that one step takes, about.
PRODUCTS = 1 << 17


def model_blocks(models: DataFrame, on: str = "condition") -> tuple[DataFrame, int]:
    """Folded models gathered to matrix rows ``(on, _pass, models array<struct<name, w, b>>)``, and the number of passes.

    Models are dealt to blocks by the hash of their name, about BLOCK_MODELS to
    a block; a pass holds about half of PASS_BYTES, by the counted models and
    their width.
    """
    m = cut_lineage(fold_scaler(models).select(on, "model_name", "_w", "_b"))
    size = m.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_w")).alias("d")).first()
    blocks = max(1, -(-size["n"] // BLOCK_MODELS))
    passes = max(1, -(-2 * size["n"] * 8 * (size["d"] or 1) // PASS_BYTES))
    block = F.pmod(F.xxhash64("model_name"), F.lit(max(blocks, passes)))
    one = F.struct(F.col("model_name").alias("name"), F.col("_w").alias("w"), F.col("_b").alias("b"))
    return cut_lineage(m.groupBy(on, block.alias("_block")).agg(F.collect_list(one).alias("models"))
                       .withColumn("_pass", F.col("_block") % passes).drop("_block")), passes


def score(rows: DataFrame, models: DataFrame, vec: str = "embedding", on: str = "condition",
          check_dims: bool = True) -> DataFrame:
    """Positive-class probability of every row under every model of its condition.

    A row meets its models a block at a time: one joined row holds the vector
    once and a matrix of models, one expression gives all probabilities, and
    only names and probabilities are unfolded (the vector stays behind). Each
    pass reads the rows once, without a shuffle, and broadcasts models within
    PASS_BYTES, however many there are.
    """
    blocks, passes = model_blocks(models, on)
    keep = [c for c in rows.columns if c != vec]
    parts = []
    for k in range(passes):
        j = rows.join(F.broadcast(blocks.where(F.col("_pass") == k).drop("_pass")), on)
        if check_dims:
            j = j.withColumn("models", F.when(
                F.assert_true(F.forall("models", lambda m: F.size(m["w"]) == F.size(vec)),
                              F.lit("vector length differs from the model's")).isNull(), F.col("models")))
        probs = F.transform("models", lambda m: F.struct(
            m["name"].alias("model_name"), sigmoid(dot(vec, m["w"]) + m["b"]).alias("prob")))
        # inline_outer: with a plain inline the optimizer infers a filter on the array and computes it twice
        parts.append(j.select(*keep, F.inline_outer(probs)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_batches(rows: DataFrame, models: DataFrame, vec: str = "embedding", on: str = "condition",
                  check_dims: bool = True) -> DataFrame:
    """As ``score``, to the last bit, for many models a condition: the training grid.

    A batch of vectors meets all models of its condition in one pass over the
    dimensions, so a product costs a few array operations for the whole batch;
    only names and probabilities are unfolded (the vector stays behind). Each
    pass reads the rows once, without a shuffle, and ships models within
    PASS_BYTES, however many there are. Sums run in the order of the dimensions.
    """
    blocks, passes = model_blocks(models, on)
    keep = [c for c in rows.columns if c != vec]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("models", T.ArrayType(T.StructType([
        T.StructField("model_name", T.StringType()), T.StructField("z", T.DoubleType())])))])
    parts = []
    for k in range(passes):
        shipped = rows.sparkSession.sparkContext.broadcast(_matrices(blocks.where(F.col("_pass") == k), on))
        j = rows.select(*keep, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(_products(shipped, keep, vec, on, check_dims), schema)
        parts.append(j.select(*keep, F.inline_outer("models")).withColumn("prob", sigmoid("z")).drop("z"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _matrices(blocks: DataFrame, on: str) -> dict:
    """Models of each condition: one (names, coefficients as dimensions x models, intercepts) for each width."""
    found: dict = {}
    for row in blocks.select(on, "models").toLocalIterator():
        for m in row["models"]:
            if row[on] is not None:
                found.setdefault(row[on], {}).setdefault(len(m["w"]), []).append(m)
    return {c: [(pa.array([m["name"] for m in ms], pa.string()), np.array([m["w"] for m in ms], float).reshape(len(ms), -1).T.copy(),
                 np.array([m["b"] for m in ms], float)) for ms in widths.values()] for c, widths in found.items()}


def _products(shipped, keep: list[str], vec: str, on: str, check_dims: bool):
    """The rows that have models, each with the names and the linear predictor of all of them (null: an element or length does not fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(on).unique():
                for names, w, b in shipped.value.get(value.as_py(), []):
                    mine = batch.filter(pc.equal(batch.column(on), value))
                    step = max(1, PRODUCTS // len(names))
                    for i in range(0, mine.num_rows, step):
                        some = mine.slice(i, step)
                        fits = pc.fill_null(pc.equal(pc.list_value_length(some.column(vec)), len(w)), False)
                        if check_dims and not pc.all(fits).as_py():
                            raise ValueError("vector length differs from the model's")
                        flat, at = some.column(vec).filter(fits).flatten(), np.flatnonzero(fits.to_numpy(zero_copy_only=False))
                        x = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(len(at), len(w)).T)
                        z = np.zeros((len(at), len(names)))
                        for of_rows, of_models in zip(x, w):
                            z += of_rows[:, None] * of_models
                        n, full, good = some.num_rows, np.zeros((some.num_rows, len(names))), np.zeros(some.num_rows, bool)
                        full[at] = z + b
                        good[at] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), len(w)).all(axis=1)
                        met = pa.StructArray.from_arrays(
                            [names.take(pa.array(np.tile(np.arange(len(names)), n))),
                             pa.array(full.ravel(), mask=~np.repeat(good, len(names)))], ["model_name", "z"])
                        off = pa.array(np.arange(n + 1) * len(names), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [*[some.column(c) for c in keep], pa.ListArray.from_arrays(off, met)], [*keep, "models"])

    return run


def centroid_models(train: DataFrame, vec: str = "embedding", by=("condition",), label: str = "y",
                    name_size: str | None = None) -> DataFrame:
    """Closed-form linear probes: standardise with the training scaler, then
    ``w = mean(x|y=1) - mean(x|y=0)``, ``b = -w . (mu1 + mu0) / 2``. Groups
    without both classes get no model. Two grouped aggregations, no loop."""
    by = list(by)
    # The global scaler is one row of 2 x dim numbers -- a model parameter, not
    # data -- so it is fetched once and attached as literals (no join).
    st = fit_scaler(train, vec).first()
    mu = F.lit(list(st["mean"])).cast("array<double>")
    sc = F.lit(list(st["scale"])).cast("array<double>")
    stdz = train.withColumn("_x", standardize(vec, mu, sc))
    cent = fit_scaler(stdz.where(F.col(label).isin(0, 1)), "_x", by + [label])
    pos = cent.where(F.col(label) == 1).select(*by, F.col("mean").alias("_m1"), F.col("n").alias("n_pos"))
    neg = cent.where(F.col(label) == 0).select(*by, F.col("mean").alias("_m0"), F.col("n").alias("n_neg"))
    w = F.zip_with("_m1", "_m0", lambda a, b: a - b)
    mid = F.zip_with("_m1", "_m0", lambda a, b: a + b)
    models = pos.join(neg, by).withColumn("coef", w).withColumn(
        "intercept", -0.5 * F.aggregate(F.zip_with("coef", mid, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    size = F.col(name_size) if name_size else (F.col("n_pos") + F.col("n_neg"))
    return models.select(*by, model_name(by[0], size).alias("model_name"), "coef", "intercept",
                         mu.alias("mean"), sc.alias("scale"), "n_pos", "n_neg")


def evaluate(scored: DataFrame, models: DataFrame, available_conditions, on: str = "condition") -> DataFrame:
    """F7 + M4 result rows: per model AUC, test counts and status.

    Models whose condition is not a column of the evaluation table get
    ``skipped_missing_condition_column`` with 0 samples and null counts; a
    one-class test set gives ``auc_undefined_single_class`` with a null AUC.
    ``num_test_samples`` counts every joined row (U-Zero nulls included).
    """
    a = auc_by(scored, ["model_name"], "y", "prob").withColumnRenamed("n_rows", "num_test_samples")
    present = F.col(on).isin(list(available_conditions))
    res = models.select("model_name", on).join(a, "model_name", "left")
    status = (F.when(~present, F.lit(STATUS_SKIPPED))
              .when(F.col("auc").isNull(), F.lit(STATUS_ONE_CLASS)).otherwise(F.lit(STATUS_OK)))
    return res.select(
        "model_name", on, F.when(present, F.col("auc")).alias("auc"),
        F.when(present, F.col("num_test_samples")).otherwise(F.lit(0)).cast("long").alias("num_test_samples"),
        F.when(present, F.col("n_pos")).cast("long").alias("num_positive_test_samples"),
        F.when(present, F.col("n_neg")).cast("long").alias("num_negative_test_samples"),
        status.alias("status"))


def best_c(grid: DataFrame, by=("condition", "sample_size"), auc: str = "val_auc",
           ordinal: str = "c_ordinal") -> DataFrame:
    """Per group the C with the highest defined AUC; the first C in list order
    wins ties; a group whose AUCs are all undefined yields no row."""
    w = Window.partitionBy(*by).orderBy(F.col(auc).desc(), F.col(ordinal).asc())
    return (grid.where(F.col(auc).isNotNull() & ~F.isnan(auc))
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def balanced_weight(label: Column, n_pos: Column, n_neg: Column) -> Column:
    """``n / (2 * n_class)`` of a row's class."""
    n = (n_pos + n_neg).cast("double")
    return n / (2.0 * F.when(label == 1, n_pos).otherwise(n_neg))


def reg_param(c: float, weight_sum: float) -> float:
    """Map the reference's ``C`` to MLlib's ``regParam``.

    Reference objective: ``1/2 |w|^2 + C * sum_i s_i * loss_i``. MLlib minimises
    ``(1 / sum_i s_i) * sum_i s_i * loss_i + regParam / 2 * |w|^2``; dividing the
    former by ``C * sum_i s_i`` gives ``regParam = 1 / (C * sum_i s_i)``. Balanced
    class weights sum to ``n``.
    """
    return 1.0 / (c * weight_sum)


def logistic_estimator(max_iter: int = 1000, tol: float = 1e-6):
    """L2 logistic regression on pre-standardised features with a free intercept."""
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(weightCol="weight", elasticNetParam=0.0, standardization=False,
                              fitIntercept=True, maxIter=max_iter, tol=tol, family="binomial")


def matching_vectors(train: DataFrame, val: DataFrame, vec: str = "embedding",
                     prefix: str = "emb_") -> tuple[DataFrame, DataFrame]:
    """Train and validation tables with their vectors in one column ``vec``.

    Wide ``emb_*`` columns are gathered in the order of the training table.
    Raises when the training table has no vectors, or the validation table
    lacks some of its vector columns.
    """
    if vec in train.columns:
        require_columns(val, [vec], "validation table")
        return train, val
    cols = wide_columns(train, prefix)
    if not cols:
        raise ValueError(f"no vectors: neither a column {vec!r} nor columns that start with {prefix!r}")
    require_columns(val, cols, "validation table")
    gathered = F.array(*[F.col(c).cast("float") for c in cols]).alias(vec)
    return (train.select(*[c for c in train.columns if c not in cols], gathered),
            val.select(*[c for c in val.columns if c not in wide_columns(val, prefix)], gathered))


def _class_counts(df: DataFrame, conditions) -> DataFrame:
    """Rows and U-Zero classes of each condition column, in one aggregation of the wide table."""
    aggs = []
    for i, c in enumerate(conditions):
        y = u_zero(F.col(f"`{c}`").cast("double"))
        aggs += [F.count(F.when(y == 1, 1)).alias(f"p{i}"), F.count(F.when(y == 0, 1)).alias(f"q{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("condition"), F.col("n"), F.col(f"p{i}").alias("n_pos"), F.col(f"q{i}").alias("n_neg"))
                     for i, c in enumerate(conditions)])
    return one.select(F.inline(each))


def plan_grid(spark: SparkSession, train: DataFrame, val: DataFrame, conditions=DEFAULT_CONDITIONS,
              sizes=None, ratio: float | None = None, key_cols=("vec_id",), seed: int | None = None):
    """F6 + A13 + J4: every cell of the grid with its status, and the sampled rows.

    Returns ``(cells, sample)``. ``cells`` has one row per (condition, sample
    size) with the classes of its sample and of the validation table, and one
    row with a null size for a condition that cannot be planned. ``sample``
    holds ``key_cols, condition, y, sizes`` of the drawn rows, without vectors.
    Nothing is fitted: whether a cell can be is known from class counts.

    Status: ``ok``; ``skipped_missing_condition_column`` (absent from either
    table); ``skipped_no_training_rows``; ``skipped_not_binary`` (a label other
    than 0 and 1); ``skipped_one_class`` (of the sample); ``skipped_auc_undefined``
    (one class in the validation table, so no C can be chosen).
    """
    from lumen.operators.sampling import (DEFAULT_MIN_OVERAGE_RATIO, DEFAULT_SAMPLE_SIZES, DEFAULT_SEED, nested_ranks,
                                          target_sizes)

    conditions, keys = list(dict.fromkeys(conditions)), list(key_cols)
    present = [c for c in conditions if c in train.columns and c in val.columns]
    ordered = spark.createDataFrame(list(enumerate(conditions)), "condition_ordinal int, condition string")
    empty = spark.createDataFrame([], "condition string, n long, n_pos long, n_neg long")
    have = cut_lineage(_class_counts(train, present)) if present else empty
    val_n = _class_counts(val, present) if present else empty
    sized = target_sizes(have.where("n > 0").select("condition", "n"), sizes or DEFAULT_SAMPLE_SIZES,
                         DEFAULT_MIN_OVERAGE_RATIO if ratio is None else ratio)
    sized = cut_lineage(sized.select("condition", "size_ordinal", "sample_size"))
    narrow = train.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in present])
    if present:
        long = narrow.unpivot(keys, present, "condition", "raw_label").select(*keys, "condition", u_zero("raw_label").alias("y"))
    else:
        long = train.select(*keys, F.lit(None).cast("string").alias("condition"), F.lit(None).cast("int").alias("y")).limit(0)
    sample = cut_lineage(nested_ranks(long, sized.select("condition", "sample_size"), ["condition"], "y", keys,
                                      DEFAULT_SEED if seed is None else seed))
    drawn = sample.select("condition", "y", F.explode("sizes").alias("sample_size")).groupBy("condition", "sample_size").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("n_pos"), F.count(F.when(F.col("y") == 0, 1)).alias("n_neg"))
    cells = (ordered.join(have.select("condition", F.col("n").alias("n_available")), "condition", "left")
             .join(sized, "condition", "left").join(drawn, ["condition", "sample_size"], "left")
             .join(val_n.select("condition", F.col("n_pos").alias("n_val_pos"), F.col("n_neg").alias("n_val_neg")), "condition", "left"))
    status = (F.when(~F.col("condition").isin(present) if present else F.lit(True), STATUS_SKIPPED)
              .when(F.col("n_available") == 0, STATUS_NO_ROWS)
              .when(F.col("n_pos") + F.col("n_neg") < F.col("sample_size"), STATUS_NOT_BINARY)
              .when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), STATUS_SAMPLE_ONE_CLASS)
              .when((F.col("n_val_pos") == 0) | (F.col("n_val_neg") == 0), STATUS_NO_AUC).otherwise(STATUS_OK))
    return cut_lineage(cells.select(
        "condition_ordinal", "condition", "size_ordinal", "sample_size", "n_available", "n_pos", "n_neg", "n_val_pos", "n_val_neg",
        status.alias("status"))), sample


def train_probes(spark: SparkSession, train: DataFrame, val: DataFrame, conditions=DEFAULT_CONDITIONS, sizes=None,
                 ratio: float | None = None, vec: str = "embedding", key_cols=("vec_id",), c_values=DEFAULT_C_VALUES,
                 seed: int | None = None, max_iter: int = 1000, tol: float = 1e-6, parallelism: int = 8,
                 rows_per_partition: int = 200_000) -> DataFrame:
    """M3 grid: per (condition, sample size) an L2 logistic regression with balanced class weights for every C; the best C
    by validation AUC wins. One row per planned cell, fitted or not, with ``status`` (see ``plan_grid``).

    * ``plan_grid`` samples by nested ranks on narrow rows; the sampled keys are
      joined to the vectors once, whatever the number of cells;
    * scalers of all cells: one grouped aggregation (A8);
    * every cell is fitted by MLlib ``LogisticRegression`` (L-BFGS over the
      cell's partitions), the objective mapped from ``C`` as ``regParam =
      1 / (C * n)``, ``fitMultiple`` over the values of C; independent cells run
      at once, and each writes its coefficients to a table in the shared folder;
    * validation AUC for every (cell, C): one job over blocks of models (J7),
      then A9 picks the winner.
    """
    import os
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.functions import array_to_vector

    keys = list(key_cols)
    train, val = matching_vectors(train, val, vec)
    cells, sample = plan_grid(spark, train, val, conditions, sizes, ratio, keys, seed)
    todo = cells.where(F.col("status") == STATUS_OK).select("condition_ordinal", "condition", "sample_size", "n_pos", "n_neg")
    member = (sample.select(*keys, "condition", "y", F.explode("sizes").alias("sample_size"))
              .join(F.broadcast(todo.select("condition", "sample_size")), ["condition", "sample_size"])
              .groupBy(*keys).agg(F.collect_list(F.struct("condition", "sample_size", "y")).alias("cells")))
    rows = cut_lineage(train.select(*keys, vec).join(member, keys).select(vec, "cells"))
    scalers = fit_scaler(rows.select(vec, F.inline("cells")), vec, ["condition", "sample_size"])
    path = os.path.join(checkpoint_dir(spark), f"probe-grid-{uuid.uuid4().hex}")

    def fit_cell(c) -> str:
        mine = F.filter("cells", lambda x: (x["condition"] == c["condition"]) & (x["sample_size"] == c["sample_size"]))
        data = rows.select(vec, mine.alias("cell")).where(F.size("cell") > 0).select(vec, F.col("cell")[0]["y"].alias("y"))
        mean, scale = (F.lit(c[k]).cast("array<double>") for k in ("mean", "scale"))
        # Partitions sized to the cell: L-BFGS runs one job per iteration.
        parts = max(1, min(task_slots(spark), (c["n_pos"] + c["n_neg"]) // rows_per_partition))
        data = (data.select(array_to_vector(standardize(vec, mean, scale)).alias("features"),
                            F.col("y").cast("double").alias("label"),
                            balanced_weight(F.col("y"), F.lit(c["n_pos"]), F.lit(c["n_neg"])).alias("weight"))
                .repartition(parts).persist())
        lr = logistic_estimator(max_iter, tol)
        maps = [{lr.regParam: reg_param(x, c["n_pos"] + c["n_neg"])} for x in c_values]
        try:
            fitted = [(c["condition"], int(c["sample_size"]), i, float(c_values[i]),
                       m.coefficients.toArray().tolist(), float(m.intercept), list(c["mean"]), list(c["scale"]))
                      for i, m in lr.fitMultiple(data, maps)]
        finally:
            data.unpersist()
        out = os.path.join(path, f"{c['condition_ordinal']}-{c['sample_size']}")  # a folder of its own: cells commit at once
        spark.createDataFrame(fitted, GRID_SCHEMA).coalesce(1).write.mode("overwrite").parquet(out)
        return out

    # one row per cell: the sizes of the plan times its conditions
    work = scalers.join(todo, ["condition", "sample_size"]).collect()
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = list(pool.map(fit_cell, work))
    grid = spark.read.schema(GRID_SCHEMA).parquet(*done) if done else spark.createDataFrame([], GRID_SCHEMA)
    grid = grid.withColumn(
        "model_name", F.concat_ws("|", "condition", F.col("sample_size").cast("string"), F.col("c_ordinal").cast("string")))
    present = sorted({r["condition"] for r in work})
    best = grid.withColumn("val_auc", F.lit(None).cast("double")).limit(0)
    if present:
        scored = score_batches(long_labels(val, keys, vec, present).select(vec, "condition", "y"), grid, vec)
        aucs = auc_by(scored, ["model_name"], "y", "prob").select("model_name", F.col("auc").alias("val_auc"))
        best = best_c(grid.join(aucs, "model_name"), ("condition", "sample_size"))
    best = best.select("condition", "sample_size", F.col("c").alias("best_c"), "val_auc", "coef", "intercept", "mean", "scale")
    return cells.join(best, ["condition", "sample_size"], "left").select(
        F.when(F.col("sample_size").isNotNull(), model_name("condition", "sample_size")).alias("model_name"),
        "condition", "sample_size", "status", "best_c", "val_auc", "coef", "intercept", "mean", "scale",
        "n_pos", "n_neg", "n_val_pos", "n_val_neg", F.when(F.col("coef").isNotNull(), F.size("coef")).alias("num_dims"))
