"""Whole flows: loaders, images at the generator, run records, stored scores, streaming upserts, sketches."""

import json
import os

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from lumen import flows
from lumen.operators.inference import generate_images
from lumen.plans import flow_queries as Q
from lumen.plans import fixtures as X
from lumen.plans import stubs
from lumen.sinks import runs as R
from lumen.sources.loaders import first_rows, load_classification, load_embedding_items, load_evaluation_labels
from lumen.sources.tables import list_images, read_label_csv

NAMES = ["edema", "atelectasis"]


def _files(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


# ------------------------------------------------------------------ images at the generator

def test_prompts_meet_decoded_images(spark, scratch):
    _files(scratch, {"p1/a.jpg": b"abc", "p1/b.jpg": b"bad", "p2/c.jpg": b"hello", "p2/unused.jpg": b"zz"})
    path = lambda n: os.path.join(scratch, n)
    items = spark.createDataFrame(
        [(1, path("p1/a.jpg"), ["x", "yy"]), (2, path("p1/b.jpg"), ["x"]), (3, path("p2/c.jpg"), ["x", "boom"]),
         (4, path("p2/none.jpg"), ["x"]), (5, None, ["x"]), (6, path("p1/a.jpg"), ["other"]), (7, path("p1/a.jpg"), ["x", "yy"]),
         (8, path("p2/c.jpg"), [])], "id int, file string, prompts array<string>")

    def generate(prompts, images):
        if "boom" in prompts:
            raise RuntimeError("boom")
        return [f"{p}:{im.decode()} " for p, im in zip(prompts, images)]

    def decode(content):
        return stubs.stub_decode(b"" if content == b"bad" else content)

    out = generate_images(items, list_images(spark, scratch, with_content=True), decode, generate, "prompts", "file",
                          size_of=stubs.stub_size)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 8 and set(items.columns) < set(out.columns)
    assert got[1].generated == got[7].generated == ["x:abc", "yy:abc"] and got[1].status == "ok" and got[1].image_size == "3x1"
    assert got[6].generated == ["other:abc"] and got[8].generated == [] and got[8].status == "ok"
    assert (got[2].status, got[2].reason, got[2].generated) == ("failed", "image_open_error", None) and "empty" in got[2].error
    assert got[3].reason == "generation_error" and got[3].generated == ["x:hello", None]
    assert got[4].reason == got[5].reason == "file_not_found"


def test_an_image_is_decoded_once_for_its_prompts(spark, scratch):
    _files(scratch, {"a.jpg": b"abc"})
    items = spark.createDataFrame([(i, os.path.join(scratch, "a.jpg"), f"p{i}") for i in range(20)], "id int, f string, prompt string")
    count = spark.sparkContext.accumulator(0)

    def decode(b):
        count.add(1)
        return b

    out = generate_images(items, list_images(spark, scratch, with_content=True), decode, lambda p, im: p, path_col="f", batch_size=3)
    assert sorted(r.generated for r in out.collect()) == sorted(f"p{i}" for i in range(20)) and count.value == 1


def test_bytes_are_never_shuffled(spark, scratch):
    _files(scratch, {"a.jpg": b"abc"})
    items = spark.createDataFrame([(1, os.path.join(scratch, "a.jpg"), "p")], "id int, f string, prompt string")
    out = generate_images(items, list_images(spark, scratch, with_content=True), stubs.stub_decode, lambda p, im: p, path_col="f")
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = text.splitlines()
    scan = next(i for i, ln in enumerate(lines) if "content" in ln and "FileScan" in ln or "BatchScan" in ln or "Scan binaryFile" in ln)
    above = [ln for ln in lines[:scan] if "MapInPandas" in ln]
    assert above  # the model stage stands above the scan
    stage = next(i for i in range(scan, -1, -1) if "MapInPandas" in lines[i])
    assert not any("Exchange" in ln and "Broadcast" not in ln for ln in lines[stage:scan])


def test_prompts_go_in_several_passes(spark, scratch, monkeypatch):
    from lumen.operators import inference
    monkeypatch.setattr(inference, "ASK_BYTES", 2000)
    _files(scratch, {f"{i}.jpg": str(i).encode() for i in range(40)})
    items = spark.createDataFrame([(i, os.path.join(scratch, f"{i}.jpg"), "p") for i in range(45)], "id int, f string, prompt string")
    out = generate_images(items, list_images(spark, scratch, with_content=True), stubs.stub_decode,
                          lambda p, im: [x.decode() for x in im], path_col="f")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") > 3
    got = {r.id: (r.generated, r.reason) for r in out.collect()}
    assert got == {i: (str(i), None) if i < 40 else (None, "file_not_found") for i in range(45)}


# ------------------------------------------------------------------ loaders

def _csv(root, parts):
    os.makedirs(root)
    for name, lines in parts.items():
        with open(os.path.join(root, name), "w") as f:
            f.write("Path,edema,note,atelectasis\n" + "".join(lines))


@pytest.mark.parametrize("split", ["128m", "200b"])
def test_first_rows_in_file_order(spark, scratch, split):
    parts = {f"b{k}.csv": [f'patient{k}{i:03d}/x.jpg,{i % 3 - 1}.0,"line\nbreak, {i}",0\n' for i in range(50)] for k in (2, 0, 1)}
    _csv(os.path.join(scratch, "t"), parts)
    want = [f"patient{k}{i:03d}/x.jpg" for k in (0, 1, 2) for i in range(50)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for n in (1, 50, 73, 150, 1000):
            df = load_classification(spark, os.path.join(scratch, "t"), NAMES, n)
            assert sorted(r.Path for r in df.collect()) == want[:n]
        assert dict(df.dtypes)["edema"] == "int" and "_row" not in df.columns
        plan = first_rows(read_label_csv(spark, os.path.join(scratch, "t"), position=True), 20)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_labels_raise_with_counts(spark, scratch):
    _csv(os.path.join(scratch, "t"), {"a.csv": ["p1,1.0,n,0\n", "p2,,n,x\n", "p3,-1,n,0.5\n", "p4,NA,n,1\n"]})
    with pytest.raises(ValueError, match="of 4 rows: edema: 2, atelectasis: 2"):
        load_classification(spark, os.path.join(scratch, "t"), NAMES)
    assert load_classification(spark, os.path.join(scratch, "t"), NAMES, 1).count() == 1  # the cap comes first
    got = load_classification(spark, os.path.join(scratch, "t"), NAMES, strict=False)
    assert {r.Path: (r.edema, r.atelectasis) for r in got.collect()} == {"p1": (1, 0), "p2": (None, None), "p3": (-1, None), "p4": (None, 1)}
    with pytest.raises(ValueError, match="missing required columns"):
        load_classification(spark, os.path.join(scratch, "t"), ["edema", "fracture"])


def test_embedding_items_and_evaluation_labels(spark, scratch):
    _csv(os.path.join(scratch, "t"), {"a.csv": ["set/v/patient7/x.jpg,1,n,0\n", "set/v/patient9000/x.jpg,1,n,0\n", "none.jpg,1,n,0\n"]})
    rows = load_embedding_items(spark, os.path.join(scratch, "t"), "/base").collect()
    assert [(r.patient_num, r.path_short, r.source_image_path, r.resolved_image_path) for r in rows] == [
        (7, "patient7/x.jpg", "set/v/patient7/x.jpg", "/base/patient7/x.jpg")]
    with pytest.raises(ValueError):
        load_embedding_items(spark, os.path.join(scratch, "t"), lower=5, upper=4)
    labels = load_evaluation_labels(spark, os.path.join(scratch, "t"), "Path string, edema double")
    assert {r.Path: r.path_short for r in labels.collect()}["set/v/patient7/x.jpg"] == "patient7/x.jpg"


# ------------------------------------------------------------------ run records

def test_a_broken_run_leaves_no_record(spark, scratch):
    studies = X.v_studies(spark, "/root/testdata/sf0.001")

    def broken(prompts, keys):
        raise SystemExit("lost")

    with pytest.raises(Exception):
        flows.report_run(spark, scratch, "r1", studies, broken)
    assert R.read_runs(spark, scratch).count() == 0
    with pytest.raises(FileNotFoundError):
        R.read_table_of(spark, scratch, "r1")
    run = flows.report_run(spark, scratch, "r1", studies, stubs.stub_generate, {"start_time": 1.0, "batch": 8}).first()
    n = run["counts"]["results.rows"]
    assert n == run["counts"]["results.ok"] == R.read_table_of(spark, scratch, "r1").count() > 0
    assert run["params"] == {"batch": "8"} and run["task"] == "report_generation" and run["started_at"] is not None
    flows.report_run(spark, scratch, "r1", studies, stubs.stub_generate, max_samples=3)  # again under its id
    flows.report_run(spark, scratch, "r2", studies, stubs.stub_generate, max_samples=4)
    got = {r["run_id"]: r["counts"]["results.rows"] for r in R.read_runs(spark, scratch).collect()}
    assert got == {"r1": 3, "r2": 4} and R.read_table_of(spark, scratch, "r1").count() == 3
    with pytest.raises(FileNotFoundError):
        R.read_table_of(spark, scratch, "r1", "models")
    with pytest.raises(ValueError):
        R.Run(spark, scratch, "t", "a/b", {}).commit()


def test_scores_are_merged_into_a_run(spark, scratch):
    flows.report_run(spark, scratch, "01", X.v_studies(spark, "/root/testdata/sf0.001"), stubs.stub_generate, {"a": 1})
    before = R.read_run(spark, scratch, "01").first()
    for _ in range(2):  # may be repeated
        flows.score_run(spark, scratch, "01", stubs.stub_extract)
    R.add_evaluation(spark, scratch, "01", "second writer", {"x": 1})
    row = R.runs_with_evaluations(spark, scratch).first()
    assert {c: row[c] for c in R.RUNS.names} == before.asDict()  # no other column changed
    e = json.loads(row["evaluations"]["report_scores"])
    assert e["schema_mode"] == "combined_full" and set(e["scores"]) == {"full_report"} and e["n_samples"] == before["counts"]["results.rows"]
    assert set(e["scores"]["full_report"]) == {"rg_e", "rg_er", "rg_er_bar"} and json.loads(row["evaluations"]["second writer"]) == {"x": 1}
    with pytest.raises(FileNotFoundError):
        R.add_evaluation(spark, scratch, "nope", "x", {})


def test_schemas_of_stored_reports(spark):
    gt, gen = "**Findings:** clear lungs", "clear lungs"
    both = spark.createDataFrame([(1, gt, gen, gt, gen, gt, gen)],
                                 "study_id int, full_gt string, full_gen string, findings_gt string, findings_gen string, impression_gt string, impression_gen string")
    sections = {m: {r.section for r in df.collect()} for df, m in (
        flows.score_reports(both, stubs.stub_extract), flows.score_reports(both.drop("full_gt"), stubs.stub_extract))}
    assert sections == {"combined_full": {"full_report", "findings", "impression"}, "separate_sections": {"full_report", "findings", "impression"}}
    only, mode = flows.score_reports(both.drop("findings_gen", "impression_gt"), stubs.stub_extract)
    assert mode == "combined_full" and {r.section for r in only.collect()} == {"full_report"}
    texts, _ = flows.report_pairs(both.drop("full_gt"))
    rebuilt = {r.side: r.text for r in texts.where("section = 'full_report'").collect()}
    assert rebuilt == {"hyp": "clear lungs clear lungs", "ref": f"{gt} {gt}"}
    with pytest.raises(ValueError, match="no accepted schema"):
        flows.score_reports(both.drop("full_gt", "findings_gt"), stubs.stub_extract)


def test_classification_and_probe_runs(spark, scratch):
    sf = "/root/testdata/sf0.001"
    run = flows.classification_run(spark, scratch, "c", Q._labels(spark, sf), Q.CONDITIONS, stubs.stub_classify_path).first()
    e = json.loads(run["evaluation"])
    assert set(e) == {"n_total_rows", "n_rows_no_ambiguous", "drop_ambiguous", "ambiguous_to_negative"}
    assert e["n_total_rows"] == run["counts"]["results.rows"] and set(e["ambiguous_to_negative"]["f1_scores"]) == set(Q.CONDITIONS)
    none = flows.classification_run(spark, scratch, "empty", Q._labels(spark, sf).limit(0), Q.CONDITIONS, stubs.stub_classify_path).first()
    assert json.loads(none["evaluation"])["n_total_rows"] == 0
    wide = X.v_cxr(spark, sf)
    t = flows.probe_training_run(spark, scratch, "p", wide, wide, conditions=["edema", "single_class", "ghost"], sizes=[64], c_values=[0.1]).first()
    assert json.loads(t["evaluation"])["cells"]["skipped_missing_condition_column"] == 1
    view = R.runs_with_models(spark, scratch)
    assert "coef" not in view.columns and {r.condition for r in view.collect()} == {"edema"} and {r.run_id for r in view.collect()} == {"p"}
    models = R.read_table_of(spark, scratch, "p", "models").drop("condition", "sample_size")
    labels = X.v_cxr_labels(spark, sf).withColumn("path_short", F.regexp_replace("path", "^(?:[^/]+/){2}", ""))
    ev = flows.probe_test_run(spark, scratch, "e", wide, labels, models).first()
    info = json.loads(ev["evaluation"])["join_info"]
    assert info["embedding_join_key"] == "path_short" and info["matched_rows"] > 0
    assert {r.run_id for r in R.read_runs(spark, scratch).collect()} == {"c", "empty", "p", "e"}


def test_patients_over_runs(spark, scratch):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("patient_num"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    for k in range(3):
        flows.embedding_run(spark, scratch, f"run{k}", rows.where((F.col("patient_num") % 5).isin(k, k + 1)))
    got = {r.run_id: (r.n_rows, r.n_distinct) for r in R.patients_over_runs(spark, scratch).collect()}
    assert got["run0"] == got["run1"] == got["run2"] == (24_000, 8_000)
    total, distinct = got[None]
    assert total == 72_000 and abs(distinct - 16_000) <= 3 * 0.0163 * 16_000


# ------------------------------------------------------------------ streaming

def test_a_second_application_continues(spark, scratch):
    from lumen.operators.filters import split_existing
    from lumen.streaming.incremental import current_rows, stage_manifest, upsert_batches
    src, sink, ck = (os.path.join(scratch, x) for x in ("src", "sink", "ck"))
    items = X.v_paths(spark, SF01).where("path IS NOT NULL").withColumn("patient_num", F.col("doc_id") % 37)
    listing = X.v_listing(spark, SF01)

    def transform(df):
        return split_existing(df, listing, "path", "decodable")

    def run():
        upsert_batches(spark, src, items.schema, transform, sink, "t", ck, max_files_per_trigger=1).awaitTermination(120)

    for i in range(2):
        items.where(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    run()
    first = current_rows(spark, sink, "doc_id").count()
    items.where(F.col("doc_id") % 3 == 2).coalesce(1).write.mode("append").parquet(src)
    items.where("doc_id < 30").withColumn("patient_num", F.lit(99).cast("long")).coalesce(1).write.mode("append").parquet(src)
    # the last batch of the first application is run again: its commit is lost, its rows are already stored
    last = max(int(n) for n in os.listdir(os.path.join(ck, "commits")) if n.isdigit())
    os.rename(os.path.join(ck, "commits", str(last)), os.path.join(scratch, "lost"))
    crc = os.path.join(ck, "commits", f".{last}.crc")
    if os.path.exists(crc):
        os.rename(crc, os.path.join(scratch, "lost.crc"))
    run()
    rows = current_rows(spark, sink, "doc_id")
    assert first < rows.count() == items.count() == rows.select("doc_id").distinct().count()
    whole = transform(items.withColumn("patient_num", F.when(F.col("doc_id") < 30, 99).otherwise(F.col("patient_num"))))
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    assert key(stage_manifest(rows)) == key(stage_manifest(whole))
    assert {r.stage for r in stage_manifest(rows).collect()} == {"done", "listing", "decode"}
