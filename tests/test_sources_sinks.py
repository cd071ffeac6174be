"""Sources and sinks: pandas-compatible CSV, image listing, metadata, models/runs tables."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumen.operators.filters import split_existing
from lumen.sinks.writers import run_row, upsert, write_embeddings, write_models, write_results
from lumen.sources.tables import (list_images, pick_schema, read_label_csv, read_model_meta, read_models,
                                  read_run, require_columns)

CSV = 'Path,Atelectasis,note\n' \
      '"a/p1/x.jpg",1.0,"line one\nline two"\n' \
      '"a/p2/y.jpg",-1.0,"say ""hi"""\n' \
      '"a/p3/z.jpg",NA,"back\\slash"\n' \
      '"a/p4/w.jpg",,None\n' \
      '"a/p5/v.jpg",0.0,\n'


def test_csv_matches_pandas_reader(spark, scratch):
    path = os.path.join(scratch, "labels.csv")
    with open(path, "w") as f:
        f.write(CSV)
    want = pd.read_csv(path)
    df = read_label_csv(spark, path, "Path string, Atelectasis double, note string")
    got = df.toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == len(want) == 5
    for c in want.columns:
        for a, b in zip(got[c].tolist(), want[c].tolist()):
            assert (pd.isna(a) and pd.isna(b)) or a == b, (c, a, b)


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    require_columns(df, ["x"])
    with pytest.raises(ValueError):
        require_columns(df, ["x", "z"])
    assert pick_schema(df, {"combined": ["full_gt", "full_gen"], "sections": ["x", "y"]}) == "sections"


def test_image_listing_and_failures(spark, scratch):
    root = os.path.join(scratch, "img")
    os.makedirs(os.path.join(root, "p1"))
    for name in ("p1/a.jpg", "b.jpg"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(b"\xff\xd8data")
    listing = list_images(spark, root).withColumn("decodable", F.lit(1))
    assert sorted(r["path"] for r in listing.collect()) == sorted(os.path.join(root, n) for n in ("p1/a.jpg", "b.jpg"))
    items = spark.createDataFrame([(os.path.join(root, "b.jpg"),), (os.path.join(root, "gone.jpg"),)], "path string")
    st = {r["path"].rsplit("/", 1)[1]: (r["status"], r["reason"]) for r in split_existing(items, listing).collect()}
    assert st == {"b.jpg": ("ok", None), "gone.jpg": ("failed", "file_not_found")}


def test_models_runs_and_metadata(spark, scratch):
    assert read_model_meta(spark, os.path.join(scratch, "missing")).count() == 0
    models = spark.createDataFrame([("edema_64", "edema", [0.1, 0.2]), ("atelectasis_64", "atelectasis", [0.3, 0.4])],
                                   "model_name string, condition string, coef array<double>")
    write_models(models, os.path.join(scratch, "models"))
    assert [r["model_name"] for r in read_models(spark, os.path.join(scratch, "models")).collect()] == \
        ["atelectasis_64", "edema_64"]
    runs_path = os.path.join(scratch, "runs")
    run_row(spark, "probe_eval", {"c_values": [0.1], "start_time": 1}, time.time(), run_id="r1") \
        .write.mode("overwrite").parquet(runs_path)
    runs = read_run(spark, runs_path, "r1")
    scan = [ln for ln in runs._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    assert scan and "EqualTo(run_id,r1)" in scan[0]  # the id lookup is pushed into the parquet scan
    r = runs.first()
    assert r["task"] == "probe_eval" and "start_time" not in r["params"]
    with pytest.raises(FileNotFoundError):
        read_run(spark, runs_path, "nope")
    out, counts = write_results(models.select("model_name"), os.path.join(scratch, "res"), "probe_eval", "12-02")
    assert out.endswith("probe_eval/run_date=12-02") and spark.read.parquet(out).count() == 2
    assert counts == {"rows": 2}
    new = spark.createDataFrame([("r1", "probe_eval", '{"auc": 0.9}')], "run_id string, task string, evaluation string")
    merged = upsert(spark.read.parquet(runs_path), new, "run_id").first()
    assert merged["evaluation"] == '{"auc": 0.9}'
    assert merged["params"] == r["params"] and merged["started_at"] == r["started_at"] and merged["runtime_s"] == r["runtime_s"]
    with pytest.raises(ValueError):
        upsert(spark.read.parquet(runs_path), new.union(new), "run_id")


def test_csv_columns_are_bound_by_name(spark, scratch):
    with open(os.path.join(scratch, "l.csv"), "w") as f:
        f.write("b,extra,a\n1,x,2\nNA,y,3\n")
    got = read_label_csv(spark, os.path.join(scratch, "l.csv"), "a int, b int").collect()
    assert [(r.a, r.b) for r in got] == [(2, 1), (3, None)]
    with pytest.raises(ValueError):
        read_label_csv(spark, os.path.join(scratch, "l.csv"), "a int, missing int")


def test_metadata_is_keyed_by_its_file(spark, scratch):
    os.makedirs(os.path.join(scratch, "meta"))
    with open(os.path.join(scratch, "meta", "edema_64.json"), "w") as f:
        f.write('{"condition": "edema",\n "sample_size": 64}')
    r = read_model_meta(spark, os.path.join(scratch, "meta")).first()
    assert (r.model_name, r.condition, r.sample_size) == ("edema_64", "edema", 64)


def test_wide_embeddings(spark, scratch):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "ok"), (2, None, "failed")],
                               "id int, embedding array<float>, status string")
    write_embeddings(df, os.path.join(scratch, "wide"), wide=True)
    back = spark.read.parquet(os.path.join(scratch, "wide"))
    assert [c for c in back.columns if c.startswith("emb_")] == ["emb_0000", "emb_0001", "emb_0002"]
    bad = spark.createDataFrame([(1, [1.0], "ok"), (2, [1.0, 2.0], "ok")], "id int, embedding array<float>, status string")
    with pytest.raises(ValueError):
        write_embeddings(bad, os.path.join(scratch, "bad"), wide=True)


def test_strict_labels_metadata_and_date_prefix(spark):
    from lumen.functions.labels import strict_label
    from lumen.functions.paths import date_prefix
    from lumen.operators.joins import attach_metadata
    ok = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "v double").select(strict_label("v").alias("y"))
    assert [r["y"] for r in ok.collect()] == [1, -1, 0]  # -1 kept, unlike U-Zero
    with pytest.raises(Exception):
        spark.createDataFrame([(1.0,), (None,)], "v double").select(strict_label("v")).collect()
    models = spark.createDataFrame([("edema_64",), ("atelectasis_512",)], "model_name string")
    meta = spark.createDataFrame([("edema_64", "edema", 64, 0.1)],
                                 "model_name string, condition string, sample_size int, best_hyperparameter_C double")
    got = {r["model_name"]: r["best_hyperparameter_C"] for r in attach_metadata(models, meta).collect()}
    assert got == {"edema_64": 0.1, "atelectasis_512": None}
    d = spark.createDataFrame([("2026-12-02 10:00:00",)], "t string").select(
        date_prefix(F.to_timestamp("t")).alias("p")).first()["p"]
    assert d == "12-02"


def test_written_counts_with_status(spark, scratch):
    df = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok")], "id int, status string")
    _, counts = write_results(df, scratch, "embed", "12-02", status_col="status")
    assert counts == {"rows": 3, "ok": 2, "failed": 1}
