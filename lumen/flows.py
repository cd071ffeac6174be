"""Whole runs: read, call the model, write results, evaluate, commit a run record.

Each flow writes its tables through ``sinks.runs`` and leaves one row per run,
written last; repeating a run under its id replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.text import clean_generated, clean_reference, full_report
from lumen.operators.metrics import distinct_counts, policy_f1
from lumen.operators.results import classification_results, probe_evaluation, report_results
from lumen.operators.setf1 import extract_entities, set_f1
from lumen.sinks.runs import Run, add_evaluation, read_table_of
from lumen.sources.tables import pick_schema

#: The two accepted shapes of stored report results, the combined one first.
REPORT_SCHEMAS = {"combined_full": ["full_gt", "full_gen"],
                  "separate_sections": ["findings_gt", "findings_gen", "impression_gt", "impression_gen"]}


def report_run(spark: SparkSession, base: str, run_id: str, studies: DataFrame, generate: Callable, params: dict | None = None,
               **how) -> DataFrame:
    """Report generation (``operators.results.report_results``) as a run; returns its row."""
    run = Run(spark, base, "report_generation", run_id, params or {})
    run.add("results", report_results(studies, generate, **how), "status")
    return run.commit()


def policy_summary(items: DataFrame, conditions) -> dict:
    """Both ambiguity policies over stored answers, in the shape of a run's evaluation."""
    per, macro = policy_f1(items)
    out = {}
    for r in macro.collect():
        out[r["policy"]] = {"macro_f1": r["macro_f1"], "f1_scores": {}, "n_items": r["n_items"] or 0}
    for r in per.collect():
        out[r["policy"]]["f1_scores"][conditions[r["condition_id"]]] = r["f1"]
    return {"n_total_rows": out.get("ambiguous_to_negative", {}).get("n_items", 0),
            "n_rows_no_ambiguous": out.get("drop_ambiguous", {}).get("n_items", 0),
            **{k: {"f1_scores": v["f1_scores"], "macro_f1": v["macro_f1"]} for k, v in out.items()}}


def classification_run(spark: SparkSession, base: str, run_id: str, labels: DataFrame, conditions, generate: Callable,
                       params: dict | None = None, **how) -> DataFrame:
    """Yes/no classification as a run: answers written, both policies evaluated on what was written."""
    conditions = list(conditions)
    run = Run(spark, base, "classification", run_id, params or {})
    rows = run.add("results", classification_results(labels, conditions, generate, **how), "status")
    return run.commit(policy_summary(rows.where("status = 'ok'").select("answers"), conditions))


def embedding_run(spark: SparkSession, base: str, run_id: str, embedded: DataFrame, params: dict | None = None,
                  patient_col: str = "patient_num") -> DataFrame:
    """Embeddings and failures (``operators.inference.embed_images``) as a run, with its patients and their sketch."""
    from lumen.sinks.writers import manifest

    run = Run(spark, base, "embedding", run_id, params or {})
    rows = run.add("results", embedded, "status")
    run.add("manifest", manifest(rows, patient_col))
    run.add("patients", distinct_counts(rows.where("status = 'ok'"), patient_col))
    return run.commit()


def probe_training_run(spark: SparkSession, base: str, run_id: str, train: DataFrame, val: DataFrame,
                       params: dict | None = None, **how) -> DataFrame:
    """The probe grid as a run: ``cells`` has every planned cell with its status, ``models`` the fitted ones."""
    from lumen.operators.probes import train_probes

    run = Run(spark, base, "probe_training", run_id, {**(params or {}), **{k: v for k, v in how.items() if k != "key_cols"}})
    grid = run.add("grid", train_probes(spark, train, val, **how), "status")
    run.add("cells", grid.drop("coef", "intercept", "mean", "scale"))
    run.add("models", grid.where("status = 'ok'"))
    status = {r["status"]: r["count"] for r in grid.groupBy("status").count().collect()}
    return run.commit({"cells": status})


def probe_test_run(spark: SparkSession, base: str, run_id: str, test: DataFrame, labels: DataFrame, models: DataFrame,
                   params: dict | None = None, **how) -> DataFrame:
    """Evaluation of a models table as a run; how rows were joined is in its evaluation."""
    run = Run(spark, base, "probe_evaluation", run_id, params or {})
    results, info = probe_evaluation(test, labels, models, **how)
    rows = run.add("results", results, "status")
    return run.commit({"join_info": vars(info), "num_models": rows.count()})


def report_pairs(results: DataFrame, key_col: str = "study_id") -> tuple[DataFrame, str]:
    """(key, section, side, text) of stored report results, and which schema they have.

    The combined schema is preferred and adds the sections it also has; the
    sections alone rebuild the full report. Neither raises before any job.
    Failed rows have no report to score and are left out.
    """
    mode = pick_schema(results, REPORT_SCHEMAS)
    have = set(results.columns)
    rows = results.where("status = 'ok'") if "status" in have else results
    hyp = {s: clean_generated(f"{s}_gen") for s in ("findings", "impression") if {f"{s}_gt", f"{s}_gen"} <= have}
    ref = {s: clean_reference(f"{s}_gt") for s in hyp}
    if mode == "combined_full":
        hyp["full_report"], ref["full_report"] = clean_generated("full_gen"), clean_reference("full_gt")
    else:
        hyp["full_report"] = full_report(hyp["findings"], hyp["impression"])
        ref["full_report"] = full_report(ref["findings"], ref["impression"])
    pairs = [F.struct(F.lit(s).alias("section"), F.lit(side).alias("side"), text[s].alias("text"))
             for s in hyp for side, text in (("hyp", hyp), ("ref", ref))]
    return rows.select(F.col(key_col).alias("sample_id"), F.inline(F.array(*pairs))), mode


def score_reports(results: DataFrame, extract: Callable, key_col: str = "study_id") -> tuple[DataFrame, str]:
    """Set-overlap F1 per section and level of stored report results (S6, X1, A10), and their schema."""
    texts, mode = report_pairs(results, key_col)
    entities = extract_entities(texts, extract, ["sample_id", "section", "side"], "text")
    return set_f1(entities, texts.select("section", "sample_id"), "sample_id", by=["section"]), mode


def score_run(spark: SparkSession, base: str, run_id: str, extract: Callable, name: str = "report_scores",
              key_col: str = "study_id") -> DataFrame:
    """Score the stored results of a run and add the scores to its record (K7); returns the score rows."""
    scores, mode = score_reports(read_table_of(spark, base, run_id), extract, key_col)
    rows = scores.collect()  # sections times levels
    table: dict = {}
    for r in rows:
        table.setdefault(r["section"], {})[r["metric"]] = r["mean_f1"]
    add_evaluation(spark, base, run_id, name, {
        "schema_mode": mode, "n_samples": max((r["n_samples"] for r in rows), default=0), "scores": table})
    return spark.createDataFrame(rows, scores.schema)
