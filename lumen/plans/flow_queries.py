"""Registered queries over whole flows: loaders, images at the generator, run records, stored scores, rounding.

Model callables are the deterministic stand-ins of ``plans.stubs``; everything
they see comes from the given tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen import flows
from lumen.functions.labels import u_zero
from lumen.functions.numbers import python_round
from lumen.functions.paths import resolve_model_meta, run_path
from lumen.operators.joins import attach_metadata
from lumen.operators.probes import centroid_models, long_labels
from lumen.operators.results import classification_results, report_results
from lumen.plans import fixtures as X
from lumen.plans import stubs
from lumen.session import checkpoint_dir
from lumen.sinks.writers import write_models
from lumen.sources.loaders import load_classification
from lumen.sources.tables import read_model_meta, read_models, read_table

CONDITIONS = X.CXR_CONDITIONS[:4]
FIRST_ROWS = 120
IMAGE_DIR = "/data"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def v_images(spark, sf) -> DataFrame:
    """Image files of the studies as ``(path, content)``: a quarter is missing, a tenth is empty; the others hold the text."""
    return read_table(spark, sf, "documents").where("doc_id % 4 <> 3").selectExpr(
        "concat('/img/', CAST(doc_id AS STRING), '.jpg') AS path",
        "IF(doc_id % 10 = 0, X'', CAST(text AS BINARY)) AS content")


def v_cxr_images(spark, sf) -> DataFrame:
    """Image files of the label table: a ninth is missing, an eighth is empty; the others hold their number."""
    return X.v_cxr(spark, sf).where("vec_id % 9 <> 4").selectExpr(
        f"concat('{IMAGE_DIR}/', path) AS path", "IF(vec_id % 8 = 0, X'', CAST(CAST(vec_id AS STRING) AS BINARY)) AS content")


def _labels(spark, sf) -> DataFrame:
    """Label table with U-Zero integers (classification itself is strict)."""
    return X.v_cxr(spark, sf).select(F.col("path").alias("Path"), *[u_zero(c).alias(c) for c in CONDITIONS])


def q_report_images(spark, sf) -> DataFrame:
    """Reports from decoded images: missing, undecodable and failing ones keep a row."""
    r = report_results(X.v_studies(spark, sf), stubs.stub_describe, listing=v_images(spark, sf), decode=stubs.stub_decode)
    return r.select("study_id", "local_image_path", "indication", "prompt_used", "full_gen", "status", "reason")


def q_cls_images(spark, sf) -> DataFrame:
    """Every condition's answer on decoded images; a failed image is one row without a condition."""
    r = classification_results(_labels(spark, sf), CONDITIONS, stubs.stub_classify_image, v_cxr_images(spark, sf), stubs.stub_decode,
                               IMAGE_DIR, size_of=stubs.stub_size)
    return r.select("path", "image_size", "status", "reason", F.inline_outer("answers")).select(
        "path", "image_size", "status", "reason", "condition", "gt", "pred", "raw")


def q_cls_first_rows(spark, sf) -> DataFrame:
    """A label CSV of several files: its first rows in file order, labels as integers (offenders are null here)."""
    path = _folder(spark, "labels-csv")
    (X.v_cxr(spark, sf).select("vec_id", F.col("path").alias("Path"), *CONDITIONS).repartitionByRange(4, "vec_id")
     .sortWithinPartitions("vec_id").write.option("header", True).csv(path))
    return load_classification(spark, path, CONDITIONS, FIRST_ROWS, strict=False).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("Path").alias("path"), *CONDITIONS)


def q_report_run(spark, sf) -> DataFrame:
    """A report run, committed, read back and scored; the run's counts beside its scores."""
    base = _folder(spark, "runs")
    run = flows.report_run(spark, base, "r1", X.v_studies(spark, sf), stubs.stub_generate, {"max_new_tokens": 512}).first()
    scores = flows.score_run(spark, base, "r1", stubs.stub_extract)
    return scores.select("section", "level", "metric", "n_samples", F.round("mean_f1", 6).alias("mean_f1"),
                         F.lit(run["counts"]["results.rows"]).alias("rows_written"), F.lit(run["counts"]["results.ok"]).alias("rows_ok"))


def q_cls_run(spark, sf) -> DataFrame:
    """A classification run: both policies as its record keeps them."""
    base = _folder(spark, "runs")
    run = flows.classification_run(spark, base, "c1", _labels(spark, sf), CONDITIONS, stubs.stub_classify_path).first()
    e = json.loads(run["evaluation"])
    rows = [(p, c, e["n_total_rows"], e["n_rows_no_ambiguous"], run["counts"]["results.rows"], float(f1), float(e[p]["macro_f1"]))
            for p in ("drop_ambiguous", "ambiguous_to_negative") for c, f1 in e[p]["f1_scores"].items()]
    df = spark.createDataFrame(rows, "policy string, condition string, n_total_rows long, n_rows_no_ambiguous long, "
                                     "rows_written long, f1 double, macro_f1 double")
    return df.withColumn("f1", F.round("f1", 6)).withColumn("macro_f1", F.round("macro_f1", 6))


def q_models_with_metadata(spark, sf) -> DataFrame:
    """Models table and metadata files, written and read back; two models have stored metadata."""
    train = long_labels(X.v_cxr(spark, sf), ["vec_id"], "embedding", X.CXR_CONDITIONS)
    base = run_path(_folder(spark, "models"), "12-02", "probe_training")
    write_models(centroid_models(train, "embedding"), f"{base}/models")
    models = read_models(spark, f"{base}/models")
    for c, stored in (("atelectasis", ""), ("edema", "Edema")):  # a file per model
        (models.where(F.col("condition") == c).select("model_name", F.lit(stored).alias("condition"), F.lit(64).alias("sample_size"),
                                                      F.lit(0.1).alias("best_hyperparameter_C"))
         .coalesce(1).write.mode("append").json(f"{base}/meta"))
    m = attach_metadata(models.select("model_name", "n_pos", "n_neg"), read_model_meta(spark, f"{base}/meta"))
    condition, size = resolve_model_meta("model_name", "condition", "sample_size")
    return m.select("model_name", condition.alias("condition"), size.alias("training_set_size"), "best_hyperparameter_C",
                    "n_pos", "n_neg")


def q_python_rounding(spark, sf) -> DataFrame:
    """Ties that are exact in binary, and decimal ties that are not, rounded to two digits."""
    e = read_table(spark, sf, "events").select(
        "event_id", ((F.col("event_id") % 2000) / 16.0).cast("double").alias("x"),
        (((F.col("event_id") % 5000) * 5).cast("double") / 1000.0).alias("y"))
    return e.select("event_id", python_round("x", 2).alias("x"), python_round("y", 2).alias("y"),
                    python_round(-F.col("y"), 2).alias("minus_y"))


QUERIES = {
    "report_images": q_report_images,
    "cls_images": q_cls_images,
    "cls_first_rows": q_cls_first_rows,
    "report_run": q_report_run,
    "cls_run": q_cls_run,
    "models_with_metadata": q_models_with_metadata,
    "python_rounding": q_python_rounding,
}
