"""Result tables in the reference's shapes, composed from the operators.

* ``report_results``: S1 -> T3 prompt -> M2 -> one row per study with the
  reference's report-result fields.
* ``classification_wide``: per-item answer arrays -> the wide per-image
  table (``gt_<c>``, ``pred_<c>``, ``raw_<c>``, ``time_<c>_s``), by plain
  array indexing (no pivot shuffle: the item is already one row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.numbers import python_round
from lumen.functions.paths import resolve_path
from lumen.functions.text import prompt_for_condition
from lumen.operators.filters import prepare_studies
from lumen.operators.inference import FAIL_GENERATE, generate_batches, generate_images
from lumen.sources.tables import require_columns


def report_results(studies: DataFrame, generate: Callable, max_samples: int = -1, batch_size: int = 8,
                   partitions: int | None = None, key_col: str = "study_id", listing: DataFrame | None = None,
                   image_col: str = "local_image_path", decode: Callable | None = None, **loading) -> DataFrame:
    """Report generation over a studies table (one generated report per study).

    Only studies with report text reach the model (the filter sits before the
    Python stage). With a ``listing`` that has ``content`` and a ``decode``, the
    generator receives prompts and decoded images. With a listing of paths only,
    or none, it receives the prompts and the study keys. Studies whose image is
    absent or cannot be opened come back as failed rows (``status``/``reason``)
    instead of vanishing.
    """
    from lumen.operators.filters import split_existing

    s = prepare_studies(studies, max_samples=max_samples)
    for c in ("dicom_id", "subject_id", image_col):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(""))
    if decode is not None:
        out = generate_images(s, listing, decode, generate, "prompt", image_col, batch_size, out_col="full_gen", **loading)
    else:
        if listing is not None:
            s = split_existing(s, listing.select(F.col("path").alias(image_col)), image_col, None)
        else:
            s = s.withColumn("status", F.lit("ok")).withColumn("reason", F.lit(None).cast("string"))
        todo = s.where(F.col("status") == "ok")
        g = generate_batches(todo, generate, "prompt", key_col, batch_size=batch_size, partitions=partitions,
                             out_col="full_gen", **loading)
        g = (g.withColumn("status", F.when(F.col("full_gen").isNull(), F.lit("failed")).otherwise(F.col("status")))
             .withColumn("reason", F.when(F.col("full_gen").isNull(), F.lit(FAIL_GENERATE)).otherwise(F.col("reason"))))
        missing = (s.where(F.col("status") != "ok").withColumn("full_gen", F.lit(None).cast("string"))
                   .withColumn("time_s", F.lit(None).cast("double")).withColumn("error", F.lit(None).cast("string")))
        out = g.unionByName(missing)
    return out.select(key_col, "dicom_id", "subject_id", F.col(image_col).alias("local_image_path"), "indication",
                      F.col("prompt").alias("prompt_used"),
                      F.col("findings").alias("findings_gt"), F.col("impression").alias("impression_gt"),
                      "full_gt", "full_gen", python_round("time_s", 2).alias("time_full_s"), "status", "reason", "error")


def classification_results(labels: DataFrame, conditions, generate: Callable, listing: DataFrame | None = None,
                           decode: Callable | None = None, image_dir: str = "", path_col: str = "Path",
                           batch_size: int = 16, size_of: Callable | None = None, **loading) -> DataFrame:
    """Yes/no classification over a label table: one row per image with an answer per condition.

    Every condition's prompt goes to the model with the image (``listing`` with
    ``content`` and ``decode``), or with the row's path when there are no files.
    Answers are parsed in place (T14). Output: ``path, image_size, answers
    array<struct<condition_id, condition, gt, pred, raw>>, time_s, status,
    reason, error``; ``answers`` is null for a failed image. Labels are strict
    integers (T10): use ``load_classification`` to count offenders beforehand.
    """
    from lumen.functions.labels import strict_label
    from lumen.functions.verdict import with_verdict_array

    conditions = list(conditions)
    require_columns(labels, [path_col, *conditions], "label table")
    gt = F.array(*[strict_label(F.col(f"`{c}`")) for c in conditions])
    prompts = F.array(*[prompt_for_condition(F.lit(c)) for c in conditions])
    items = labels.select(F.col(path_col).alias("path"), resolve_path(F.col(path_col), image_dir).alias("_file")
                          if image_dir else F.col(path_col).alias("_file"), gt.alias("_gt"), prompts.alias("_prompts"))
    if decode is not None:
        g = generate_images(items, listing, decode, generate, "_prompts", "_file", batch_size, out_col="_raw", size_of=size_of, **loading)
    else:
        g = generate_batches(items, generate, "_prompts", "_file", batch_size=batch_size, out_col="_raw", **loading)
        g = (g.withColumn("image_size", F.lit(None).cast("string"))
             .withColumn("reason", F.when(F.col("error").isNotNull(), F.lit(FAIL_GENERATE)))
             .withColumn("status", F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.lit("ok"))))
    answers = F.array(*[F.struct(F.lit(i).alias("condition_id"), F.col("_gt")[i].alias("gt"), F.get("_raw", F.lit(i)).alias("raw"))
                        for i in range(len(conditions))])
    parsed = with_verdict_array(g.select("path", "image_size", "time_s", "status", "reason", "error", "_raw", answers.alias("answers")), "answers")
    names = F.array(*[F.lit(c) for c in conditions])
    parsed = parsed.withColumn("answers", F.transform("answers", lambda a, i: F.struct(
        a["condition_id"].alias("condition_id"), F.get(names, i).alias("condition"), a["gt"].alias("gt"), a["pred"].alias("pred"),
        F.get("_raw", i).alias("raw")))).drop("_raw")
    return parsed.withColumn("answers", F.when(F.col("status") == "ok", F.col("answers")))


def classification_wide(items: DataFrame, conditions, key_cols=("item_id",), answers: str = "answers",
                        time_col: str | None = None) -> DataFrame:
    """Per-item answers (``array<struct<gt, pred, raw?>>`` in condition order) as
    the reference's wide result row."""
    elem = {f.name for f in items.schema[answers].dataType.elementType.fields}
    cols = [F.col(c) for c in key_cols]
    for i, c in enumerate(conditions):
        a = F.col(answers)[i]
        cols += [a["gt"].alias(f"gt_{c}"), a["pred"].alias(f"pred_{c}")]
        if "raw" in elem:
            cols.append(a["raw"].alias(f"raw_{c}"))
        if time_col:
            cols.append(python_round(F.col(time_col), 3).alias(f"time_{c}_s"))
    return items.select(*cols)


def probe_evaluation(test: DataFrame, labels: DataFrame, models: DataFrame, meta: DataFrame | None = None,
                     vec: str = "embedding", key_cols=("vec_id",)):
    """Evaluate a models table on test embeddings (the probe-test flow).

    Best-key join of embeddings and labels (J1/J8/F9), stored metadata
    preferred over the name (J5/T19), every model scored on every joined row
    of its condition (M4/J7, equi-join on condition), exact AUC and status
    per model (A5/F7). Returns ``(results, join_info)``.
    """
    from lumen.functions.paths import resolve_model_meta
    from lumen.operators.joins import best_key_join
    from lumen.operators.probes import evaluate, long_labels, score

    joined, info = best_key_join(test, labels)
    m = models
    if meta is not None:
        m = m.join(meta.select("model_name", F.col("condition").alias("_mc"), F.col("sample_size").alias("_ms"),
                               "best_hyperparameter_C"), "model_name", "left")
    else:
        m = m.withColumn("_mc", F.lit(None).cast("string")).withColumn("_ms", F.lit(None).cast("int")) \
             .withColumn("best_hyperparameter_C", F.lit(None).cast("double"))
    cond, size = resolve_model_meta("model_name", "_mc", "_ms")
    m = m.withColumn("condition", cond).withColumn("training_set_size", size)
    conds = [r["condition"] for r in m.select("condition").distinct().collect()]  # one row per model condition
    present = [c for c in conds if c in joined.columns]
    if present:
        test_long = long_labels(joined, list(key_cols), vec, present)
        scored = score(test_long.select(*key_cols, vec, "condition", "y"), m.where(F.col("condition").isin(present)), vec)
    else:
        scored = None
    if scored is None:
        res = m.select("model_name", "condition", F.lit(None).cast("double").alias("auc"),
                       F.lit(0).cast("long").alias("num_test_samples"),
                       F.lit(None).cast("long").alias("num_positive_test_samples"),
                       F.lit(None).cast("long").alias("num_negative_test_samples"),
                       F.lit("skipped_missing_condition_column").alias("status"))
    else:
        res = evaluate(scored, m, present)
    extra = m.select("model_name", "training_set_size", "best_hyperparameter_C")
    return res.join(extra, "model_name", "left").orderBy("model_name"), info
