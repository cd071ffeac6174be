"""Registered queries: one per operator group of the inventory.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame (some run small sizing jobs first) whose
columns are aliased to match ``lumen.plans.oracle.ORACLE_SQL``. Doubles are
rounded to 6 places on the output projection only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions import text as TX
from lumen.functions.labels import u_zero
from lumen.functions.paths import (drop_two_dirs, patient_num, resolve_model_meta, resolve_path,
                                   short_from_patient)
from lumen.functions.vectors import l2_norm, l2_normalize, to_wide
from lumen.functions.verdict import with_verdict, with_verdict_array
from lumen.operators import filters as FL
from lumen.operators import metrics as M
from lumen.operators.joins import best_key_join, candidate_counts
from lumen.operators.probes import DEFAULT_CONDITIONS, best_c, centroid_models, evaluate, long_labels, score
from lumen.operators.sampling import stratified_exact, target_sizes
from lumen.operators.scaler import fit_scaler
from lumen.operators.setf1 import set_f1
from lumen.plans import fixtures as X
from lumen.session import parallelism
from lumen.sources.tables import read_table


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ------------------------------------------------------------------ T14 / A1-A4

def _verdict_items(spark, sf) -> DataFrame:
    """Per-item rows with parsed answers: ``answers: array<struct<condition_id, gt, pred, stage>>``."""
    return with_verdict_array(X.v_verdict_items(spark, sf), "answers")


def q_verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    v = with_verdict(X.v_verdicts(spark, sf), "raw")
    return v.select("item_id", "condition_id", "gt", F.col("v.verdict").alias("verdict"),
                    F.col("v.stage").alias("stage"))


def q_cls_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: verdicts -> ambiguous-to-negative -> F1 per condition."""
    v = with_verdict(X.v_verdicts(spark, sf), "raw")
    pred = F.col("v.verdict")
    long = v.select("condition_id", "gt", F.when(pred == -1, 0).otherwise(pred).alias("pred"))
    out = M.f1_by(long, ["condition_id"], "gt", "pred")
    return out.select("condition_id", "n_rows", "tp", "fp", "fn", "gt_pos", "pred_pos", _r("f1").alias("f1"))


def q_cls_policies(spark: SparkSession, sf: str) -> DataFrame:
    per_cond, _ = M.policy_f1(_verdict_items(spark, sf))
    return per_cond.select("policy", "condition_id", "n_rows", "tp", "fp", "fn", "gt_pos", "pred_pos",
                           _r("f1").alias("f1"))


def q_cls_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    _, macro = M.policy_f1(_verdict_items(spark, sf))
    return macro.select("policy", _r("macro_f1").alias("macro_f1"), "n_conditions", "n_items")


QUERIES = {
    "verdict_parse": q_verdict_parse,
    "cls_f1": q_cls_f1,
    "cls_policies": q_cls_policies,
    "cls_macro_f1": q_cls_macro_f1,
}


# ------------------------------------------------------------------ S1 / T1-T4a / L1


STUDY_COLS = ["study_id", "subject_id", "dicom_id", "local_image_path", "findings", "impression",
              "indication", "full_gt", "prompt"]
IMAGE_BASE = "/data/images"
PATIENT_LO, PATIENT_HI = 1, 150  # the range query
PATIENT_FIRST, PATIENT_LAST = 1, 8528  # fixed values: the whole range of patient numbers


def q_studies_clean(spark, sf):
    return FL.prepare_studies(X.v_studies(spark, sf)).select(*STUDY_COLS)


def q_studies_first_n(spark, sf):
    return FL.prepare_studies(X.v_studies(spark, sf), max_samples=100).select(*STUDY_COLS)


def q_prompts_by_condition(spark, sf):
    s = FL.prepare_studies(X.v_studies(spark, sf)).select("study_id")
    conds = F.array(*[F.lit(c) for c in DEFAULT_CONDITIONS])
    x = s.select("study_id", F.explode(conds).alias("condition"))
    return x.select("study_id", "condition", TX.prompt_for_condition("condition").alias("prompt"))


def q_chat_messages(spark, sf):
    s = FL.prepare_studies(X.v_studies(spark, sf))
    msgs = TX.chat_messages("prompt", with_system=True)
    return s.select("study_id", F.size(msgs).alias("n_messages"), F.to_json(msgs).alias("chat_json"),
                    TX.plain_prompt("prompt").alias("plain_prompt"))


def q_gen_text_clean(spark, sf):
    p = X.v_pairs(spark, sf)
    x = p.select("sample_id",
                 TX.clean_generated("findings_gen").alias("findings_gen"),
                 TX.clean_generated("impression_gen").alias("impression_gen"),
                 TX.clean_reference("findings_gt").alias("findings_gt"),
                 TX.clean_reference("impression_gt").alias("impression_gt"))
    return x.select("*", TX.full_report("findings_gen", "impression_gen").alias("full_gen"),
                    TX.full_report("findings_gt", "impression_gt").alias("full_gt"))


# ------------------------------------------------------------------ T5-T8 / F2 / A6 / F3 F5

def q_path_keys(spark, sf):
    p = X.v_paths(spark, sf)
    return p.select("doc_id", "path", patient_num("path").alias("patient_num"),
                    short_from_patient("path").alias("path_short"),
                    drop_two_dirs("path").alias("path_short_b"),
                    resolve_path("path", IMAGE_BASE).alias("resolved_path"))


def q_patient_range(spark, sf):
    p = X.v_paths(spark, sf)
    n = patient_num("path")
    inside = n.between(PATIENT_LO, PATIENT_HI)
    sums = p.agg(F.count(F.when(inside, 1)).alias("n_rows_in_range"), F.countDistinct(F.when(inside, n)).alias("n_patients_in_range"),
                 F.count(F.lit(1)).alias("n_rows_total"), F.countDistinct(n).alias("n_patients_total"))
    return sums.select(F.lit(PATIENT_LO).alias("lower"), F.lit(PATIENT_HI).alias("upper"), "*")


def _embedding_items(spark, sf):
    items = FL.patient_range(X.v_paths(spark, sf), PATIENT_FIRST, PATIENT_LAST)
    return FL.split_existing(items, X.v_listing(spark, sf), "path", "decodable")


def q_file_failures(spark, sf):
    return _embedding_items(spark, sf).select("doc_id", "path", "patient_num", "path_short", "status", "reason")


def q_failure_manifest(spark, sf):
    from lumen.sinks.writers import manifest
    return manifest(_embedding_items(spark, sf))


# ------------------------------------------------------------------ T9 / A3 / A7

def _cxr_long(spark, sf):
    return long_labels(X.v_cxr(spark, sf), ["vec_id", "path", "path_short"], "embedding", X.CXR_CONDITIONS)


def q_u_zero_labels(spark, sf):
    l = _cxr_long(spark, sf)
    r = F.col("raw_label")
    agg = l.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("y") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("y") == 0, 1)).alias("n_neg"),
        F.count(F.when(r.isNull(), 1)).alias("n_raw_null"),
        F.count(F.when(r == -1.0, 1)).alias("n_raw_uncertain"))
    can = (F.when(F.col("n_pos") > 0, (F.col("n_pos") >= 2) & ((F.col("n_neg") >= 2) | (F.col("n_neg") == 0)))
           .otherwise(F.lit(False)))
    return agg.withColumn("can_stratify", can)


# ------------------------------------------------------------------ J1 / J8 / F9

def _joined(spark, sf):
    left = X.v_cxr(spark, sf)
    right = X.v_cxr_labels(spark, sf).withColumn("path_short", drop_two_dirs("path"))
    return best_key_join(left, right)


def q_best_key_join(spark, sf):
    joined, info = _joined(spark, sf)
    return joined.select("vec_id", "path", "path_short", "path_label", "atelectasis", "atelectasis_label",
                         "only_in_labels", F.lit(info.embedding_join_key).alias("embedding_join_key"),
                         F.lit(info.matched_rows).cast("long").alias("matched_rows"))


def q_best_key_counts(spark, sf):
    left = X.v_cxr(spark, sf)
    right = X.v_cxr_labels(spark, sf).withColumn("path_short", drop_two_dirs("path"))
    return candidate_counts(left, right).select("ordinal", "embedding_join_key", "label_join_key", "matched_rows")


def q_hot_key_join(spark, sf):
    """Events to customers by path: a third of the events share one path and others have none."""
    left, right = X.v_hot_events(spark, sf), X.v_hot_customers(spark, sf)
    joined, info = best_key_join(left, right, rows_per_task=500, sums=(["event_id"], ["c_custkey"]))
    return joined.groupBy("path").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("sum_event_id").alias("sum_event"), F.sum("sum_c_custkey").alias("sum_customer"),
        F.lit(info.matched_rows).cast("long").alias("matched_rows"), F.lit(info.null_key_rows).cast("long").alias("null_key_rows"))


# ------------------------------------------------------------------ A5

def q_auc_exact(spark, sf):
    a = M.auc_by(X.v_scores(spark, sf), ["model_id"], "y", "score")
    return a.select("model_id", "n_pos", "n_neg", _r("auc").alias("auc"))


def q_auc_bucketed(spark, sf):
    a = M.auc_by(X.v_scores(spark, sf), ["model_id"], "y", "score", buckets=4)
    return a.select("model_id", "n_pos", "n_neg", _r("auc").alias("auc"))


# ------------------------------------------------------------------ A13 / N1

def _plan(spark, sf):
    l = _cxr_long(spark, sf)
    counts = l.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    return l, target_sizes(counts)


def q_target_sizes(spark, sf):
    _, plan = _plan(spark, sf)
    return plan.select("condition", "n", "size_ordinal", "sample_size", "is_full")


def q_stratified_sample_counts(spark, sf):
    l, plan = _plan(spark, sf)
    s = stratified_exact(l, plan, ["condition"], "y", ["vec_id"])
    return s.groupBy("condition", "sample_size").agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count(F.when(F.col("y") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("y") == 0, 1)).alias("n_neg"), F.countDistinct("vec_id").alias("n_distinct"))


# ------------------------------------------------------------------ A8 / T16 / T17

def q_scaler_stats(spark, sf):
    st = fit_scaler(read_table(spark, sf, "embeddings"), "embedding")
    x = st.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "z"))
    return x.select(F.col("dim").cast("int").alias("dim"), _r("z.mean").alias("mean"), _r("z.std").alias("std"))


def q_l2_norms(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * 3.0).alias("v"))
    n = e.select("vec_id", "v", l2_normalize("v").alias("u"))
    return n.select("vec_id", _r(l2_norm("v")).alias("norm_before"), _r(l2_norm("u")).alias("norm_after"),
                    _r(F.element_at("u", 1)).alias("u_first"))


def q_wide_long(spark, sf):
    from lumen.functions.vectors import assert_uniform_dim, to_array
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    wide = to_wide(e, assert_uniform_dim(e, "embedding"))
    back = to_array(wide)
    return back.select("vec_id", F.col("embedding")[0].alias("emb_0000"), F.col("embedding")[63].alias("emb_0063"),
                       F.size("embedding").alias("n_dims"),
                       _r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("emb_sum"))


# ------------------------------------------------------------------ M4 / M5 / J7 / F7 / T18 T19 / A9

PROBE_CONDITIONS = X.CXR_CONDITIONS


def _centroids(spark, sf):
    train = _cxr_long(spark, sf)
    return train, centroid_models(train, "embedding")


def q_probe_score(spark, sf):
    train, models = _centroids(spark, sf)
    s = score(train.select("vec_id", "embedding", "condition", "y"), models, "embedding")
    return s.select("vec_id", "condition", "y", _r("prob").alias("prob"))


def q_probe_eval(spark, sf):
    _, models = _centroids(spark, sf)
    joined, _info = _joined(spark, sf)
    present = [c for c in PROBE_CONDITIONS if c in joined.columns]
    test = long_labels(joined, ["vec_id"], "embedding", present)
    scored = score(test.select("vec_id", "embedding", "condition", "y"), models, "embedding")
    ev = evaluate(scored, models, present)
    return ev.select("model_name", "condition", _r("auc").alias("auc"), "num_test_samples",
                     "num_positive_test_samples", "num_negative_test_samples", "status")


def q_model_name_parse(spark, sf):
    n = X.v_names(spark, sf)
    cond, size = resolve_model_meta("model_name", "meta_condition", "meta_size")
    return n.select("model_id", "model_name", cond.alias("condition"), size.alias("training_set_size"))


def q_probe_eval_status(spark, sf):
    """F7 for named models: a model whose condition is no column of the joined
    evaluation table is skipped with 0 samples; others report the test counts."""
    n = X.v_names(spark, sf)
    cond, size = resolve_model_meta("model_name", "meta_condition", "meta_size")
    models = n.select("model_id", "model_name", cond.alias("condition"), size.alias("training_set_size"))
    joined, _info = _joined(spark, sf)
    present = [c for c in joined.columns if c not in ("vec_id", "embedding", "path", "path_short", "path_label")]
    test = long_labels(joined, ["vec_id"], "embedding", present)
    counts = test.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("y") == 0, 1)).alias("n_neg"))
    j = models.join(counts, "condition", "left")
    ok = F.col("n").isNotNull()
    return j.select("model_id", "model_name", "condition", "training_set_size",
                    F.when(ok, "ok").otherwise("skipped_missing_condition_column").alias("status"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("num_test_samples"),
                    F.col("n_pos").cast("long").alias("num_positive_test_samples"),
                    F.col("n_neg").cast("long").alias("num_negative_test_samples"))


def q_best_c(spark, sf):
    g = X.v_grid_scores(spark, sf)
    aucs = M.auc_by(g, ["model_id", "c_ordinal", "c"], "y", "score")
    best = best_c(aucs.withColumnRenamed("auc", "val_auc"), ("model_id",), "val_auc", "c_ordinal")
    return best.select("model_id", "c_ordinal", "c", _r("val_auc").alias("val_auc"))


# ------------------------------------------------------------------ X1 / A10

def q_set_f1(spark, sf):
    r = set_f1(X.v_entities(spark, sf))
    return r.select("level", "metric", "n_samples", _r("mean_f1").alias("mean_f1"))


# ------------------------------------------------------------------ M1 / M2

def q_embed_retry(spark, sf):
    from lumen.operators.inference import embed_batches
    from lumen.plans.stubs import stub_embed
    d = read_table(spark, sf, "documents").select("doc_id")
    e = embed_batches(d, stub_embed, batch_size=16, partitions=parallelism(spark))
    return e.select("doc_id", "status", "reason",
                    F.transform(l2_normalize("embedding"), lambda x: x.cast("float")).alias("embedding"))


def q_generate_stub(spark, sf):
    """Report generation result table (S1 -> M2), answers parsed downstream."""
    from lumen.operators.results import report_results
    from lumen.plans.stubs import stub_generate
    r = report_results(X.v_studies(spark, sf), stub_generate, batch_size=8,
                       partitions=parallelism(spark))
    g = with_verdict(r, "full_gen")
    return g.select("study_id", F.col("prompt_used").alias("prompt"), F.col("full_gen").alias("generated"),
                    F.col("v.verdict").alias("verdict"))


# ------------------------------------------------------------------ K7

def q_upsert_evaluation(spark, sf):
    from lumen.sinks.writers import upsert
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("task"),
        F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    new = read_table(spark, sf, "labels").select(F.col("doc_id").alias("run_id"), "quality", "toxic")
    return upsert(docs, new, "run_id").select("run_id", "task", "quality", "toxic")



QUERIES.update({
    "studies_clean": q_studies_clean,
    "studies_first_n": q_studies_first_n,
    "prompts_by_condition": q_prompts_by_condition,
    "chat_messages": q_chat_messages,
    "gen_text_clean": q_gen_text_clean,
    "path_keys": q_path_keys,
    "patient_range": q_patient_range,
    "file_failures": q_file_failures,
    "failure_manifest": q_failure_manifest,
    "u_zero_labels": q_u_zero_labels,
    "best_key_join": q_best_key_join,
    "best_key_counts": q_best_key_counts,
    "hot_key_join": q_hot_key_join,
    "auc_exact": q_auc_exact,
    "auc_bucketed": q_auc_bucketed,
    "target_sizes": q_target_sizes,
    "stratified_sample_counts": q_stratified_sample_counts,
    "scaler_stats": q_scaler_stats,
    "l2_norms": q_l2_norms,
    "wide_long": q_wide_long,
    "probe_score": q_probe_score,
    "probe_eval": q_probe_eval,
    "model_name_parse": q_model_name_parse,
    "probe_eval_status": q_probe_eval_status,
    "best_c": q_best_c,
    "set_f1": q_set_f1,
    "embed_retry": q_embed_retry,
    "generate_stub": q_generate_stub,
    "upsert_evaluation": q_upsert_evaluation,
})


# ------------------------------------------------------------------ M3 / A9 / A11 / J4 / N1 (solver: rows-only check)

#: One condition of the grid has no column, as when a label table lacks it.
GRID_CONDITIONS = [*X.CXR_CONDITIONS, "pneumonia"]


def q_probe_grid(spark, sf):
    """The planned grid: every (condition, size) with the classes of its sample, and why it is not fitted."""
    from lumen.operators.probes import plan_grid
    joined, _info = _joined(spark, sf)
    cells, _sample = plan_grid(spark, X.v_cxr(spark, sf), joined, GRID_CONDITIONS)
    return cells.drop("condition_ordinal")


def q_probe_train(spark, sf):
    """Train the probe grid on v_cxr (train) and score C on the best-key-joined
    evaluation rows (val): one row per planned (condition, size), fitted or not."""
    from lumen.operators.probes import train_probes
    joined, _info = _joined(spark, sf)
    models = train_probes(spark, X.v_cxr(spark, sf), joined, GRID_CONDITIONS)
    return models.select("model_name", "condition", "sample_size", "status", "best_c", _r("val_auc").alias("val_auc"),
                         "n_pos", "n_neg", "num_dims")


QUERIES["probe_grid"] = q_probe_grid
QUERIES["probe_train"] = q_probe_train


# ------------------------------------------------------------------ report scoring: T11-T13 -> X1 (injected extractor) -> A10

def q_report_scores(spark, sf):
    """Generated vs reference reports: clean, split into sections (findings,
    impression, rebuilt full report), extract entities with the injected
    model in Arrow batches, then set-overlap F1 per section and level."""
    from lumen.operators.setf1 import extract_entities
    from lumen.plans.stubs import stub_extract
    p = q_gen_text_clean(spark, sf)
    texts = p.select("sample_id", F.inline(F.array(*[
        F.struct(F.lit(sec).alias("section"), F.lit(side).alias("side"), F.col(col).alias("text"))
        for sec, pair in [("findings", ("findings_gen", "findings_gt")),
                          ("impression", ("impression_gen", "impression_gt")),
                          ("full_report", ("full_gen", "full_gt"))]
        for side, col in zip(("hyp", "ref"), pair)])))
    ents = extract_entities(texts, stub_extract, ["sample_id", "section", "side"], "text")
    samples = texts.select("section", "sample_id")
    r = set_f1(ents, samples, "sample_id", by=["section"])
    return r.select("section", "level", "metric", "n_samples", _r("mean_f1").alias("mean_f1"))


# ------------------------------------------------------------------ classification end to end: S2 -> T4 -> M2 -> T14 -> F4/T15 -> A1-A4

CLS_CONDITIONS = ["atelectasis", "cardiomegaly", "consolidation", "edema"]


def q_cls_end_to_end(spark, sf):
    """One row per image with one prompt per condition; the generator answers all
    prompts of a batch in one call; answers are parsed in place; truth is the
    U-Zero label; both ambiguity policies are scored in one aggregation."""
    from lumen.functions.verdict import with_verdict_array
    from lumen.operators.inference import generate_batches
    from lumen.plans.stubs import stub_classify
    cx = X.v_cxr(spark, sf).select("vec_id", *CLS_CONDITIONS)
    prompts = F.array(*[TX.prompt_for_condition(F.lit(c)) for c in CLS_CONDITIONS])
    g = generate_batches(cx.withColumn("prompts", prompts), stub_classify, "prompts", "vec_id", batch_size=16)
    answers = F.array(*[F.struct(F.lit(i).alias("condition_id"), u_zero(c).alias("gt"),
                                 F.col("generated")[i].alias("raw")) for i, c in enumerate(CLS_CONDITIONS)])
    items = with_verdict_array(g.select("vec_id", answers.alias("answers")), "answers")
    per, _ = M.policy_f1(items)
    return per.select("policy", "condition_id", "n_rows", "tp", "fp", "fn", "gt_pos", "pred_pos",
                      _r("f1").alias("f1"))


QUERIES["report_scores"] = q_report_scores
QUERIES["cls_end_to_end"] = q_cls_end_to_end

from lumen.plans.flow_queries import QUERIES as _FLOWS  # noqa: E402

QUERIES.update(_FLOWS)
