"""N1 exact stratified samples; J1 best-key join; K7 upsert."""

import pytest
from pyspark.sql import functions as F

from lumen.operators.joins import best_key_join, candidate_counts
from lumen.operators.sampling import class_quotas, stratified_exact
from lumen.sinks.writers import upsert


def _pop(spark, parts):
    rows = [("a", i, 1 if i % 13 == 0 else 0) for i in range(500)] + [("b", i, 0) for i in range(300)]
    return spark.createDataFrame(rows, "g string, k int, y int").repartition(parts)


def test_exact_size_quotas_and_partition_independence(spark):
    plan = spark.createDataFrame([("a", 64), ("a", 250), ("a", 500), ("b", 64)], "g string, sample_size long")
    picks = []
    for parts in (1, 4, 16):
        s = stratified_exact(_pop(spark, parts), plan, ["g"], "y", ["k"], seed=42)
        picks.append(sorted((r["g"], r["sample_size"], r["k"]) for r in s.collect()))
    assert picks[0] == picks[1] == picks[2]
    by = {}
    for g, size, k in picks[0]:
        by.setdefault((g, size), []).append(k)
    for (g, size), ks in by.items():
        assert len(ks) == size and len(set(ks)) == size
    pos = [k for k in by[("a", 64)] if k % 13 == 0]
    assert len(pos) == 5  # 39 of 500 positives: 64 * 39 / 500 = 4.992 -> 4 + the larger remainder
    for bins in (1, 5):
        binned = stratified_exact(_pop(spark, 4), plan, ["g"], "y", ["k"], seed=42, bins=bins)
        assert sorted((r["g"], r["sample_size"], r["k"]) for r in binned.collect()) == picks[0]
    q = class_quotas(_pop(spark, 2), plan, ["g"], "y").where("g = 'a' AND sample_size = 64").collect()
    assert sum(r["quota"] for r in q) == 64


def test_quota_rule(spark):
    plan = spark.createDataFrame([("a", 64)], "g string, sample_size long")
    q = {r["_cls"]: r["quota"] for r in class_quotas(_pop(spark, 2), plan, ["g"], "y").collect()}
    # class 1 has 39 rows, class 0 has 461: 64*39/500 = 4.992, 64*461/500 = 59.008
    assert q == {1: 5, 0: 59}


def test_best_key_join_counts_and_ties(spark):
    left = spark.createDataFrame([(1, "p/x/a", "a"), (2, "p/x/b", "b"), (3, "p/x/b", "b"), (4, None, None)],
                                 "id int, path string, path_short string")
    right = spark.createDataFrame([("q/y/a", "a", 1.0), ("q/y/b", "b", 0.0), ("p/x/a", "a", 1.0)],
                                  "path string, path_short string, lab double")
    counts = {r["ordinal"]: r["matched_rows"] for r in candidate_counts(left, right).collect()}
    joined, info = best_key_join(left, right)
    assert counts == {0: 1, 2: 4} and info.embedding_join_key == "path_short"
    assert joined.count() == info.matched_rows == 4
    assert "path_label" in joined.columns and info.embedding_rows_total == 4 and info.label_rows_total == 3
    # tie: earliest candidate wins
    r2 = spark.createDataFrame([("p/x/a", "zz", 1.0)], "path string, path_short string, lab double")
    l2 = spark.createDataFrame([(1, "p/x/a", "zz")], "id int, path string, path_short string")
    _, info2 = best_key_join(l2, r2)
    assert info2.embedding_join_key == "path"
    with pytest.raises(ValueError):
        best_key_join(l2, r2.withColumn("path", F.lit("nope")).withColumn("path_short", F.lit("nope")))


def test_label_side_option(spark):
    left = spark.createDataFrame([(1, "k", 0.0)], "id int, path_short string, edema double")
    right = spark.createDataFrame([("k", 1.0)], "path_short string, edema double")
    j_left, _ = best_key_join(left, right)
    j_right, _ = best_key_join(left, right, label_side="right")
    assert j_left.first()["edema"] == 0.0 and j_left.first()["edema_label"] == 1.0
    assert j_right.first()["edema"] == 1.0


def test_null_paths_have_no_short_key(spark):
    left = spark.createDataFrame([(1, "x", "s"), (2, None, None), (3, None, None)], "id int, source_image_path string, path_short string")
    right = spark.createDataFrame([("q", "s", 1.0), (None, None, 0.0), (None, None, 0.0)], "path string, path_short string, edema double")
    joined, info = best_key_join(left, right, candidates=[("path_short", "path_short")])
    assert info.matched_rows == 1 and [r.id for r in joined.collect()] == [1]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None)], "run_id int, task string, ev string")
    new = spark.createDataFrame([(2, "b", "x")], "run_id int, task string, ev string")
    got = sorted(tuple(r) for r in upsert(old, new, "run_id").collect())
    assert got == [(1, "a", None), (2, "b", "x")]
    with pytest.raises(FileNotFoundError):
        upsert(old, spark.createDataFrame([(9, "z", "x")], "run_id int, task string, ev string"), "run_id")


def test_hot_and_null_keys_are_spread(spark):
    """A key and the null key with a third of the rows each: rows and counts as brute force, no task with a third."""
    import pandas as pd
    from lumen.operators.joins import split_key_join, key_counts
    left = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(3000)]
    right = [(i, "hot" if i < 30 else None if i < 45 else f"k{i}") for i in range(3000)]
    lf = spark.createDataFrame(left, "id int, path string").repartition(5)
    rf = spark.createDataFrame(right, "rid int, path string").repartition(3)
    want = pd.DataFrame(left, columns=["id", "path"]).merge(pd.DataFrame(right, columns=["rid", "path"]), on="path")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        joined, info = best_key_join(lf, rf, rows_per_task=10)
        got = joined.select("id", "rid", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.id, r.rid) for r in got) == sorted(zip(want["id"], want["rid"]))
    assert info.matched_rows == len(want) and info.null_key_rows == 1000 * 15
    tasks = pd.Series([r.p for r in got]).value_counts()
    assert len(tasks) > 20 and tasks.max() < 0.08 * len(got)  # a hot key alone holds two thirds of the result
    counts, _ = key_counts(lf, rf, [("path", "path")])
    plain = split_key_join(lf, rf.withColumnRenamed("path", "_rkey"), "path", "_rkey", counts, rows_per_task=10**6)
    assert sorted((r.id, r.rid) for r in plain.collect()) == sorted(zip(want["id"], want["rid"]))


def test_join_counts_of_empty_tables(spark):
    left = spark.createDataFrame([], "id int, path string, path_short string")
    right = spark.createDataFrame([], "path string, path_short string")
    assert [(r.ordinal, r.matched_rows, r.left_rows) for r in candidate_counts(left, right).orderBy("ordinal").collect()] == [(0, 0, 0), (2, 0, 0)]
    with pytest.raises(ValueError):
        best_key_join(left, right)


def test_sums_over_the_pairs_of_a_hot_key(spark):
    """Sums by key as brute force gives them, from rows that grow with the inputs and not with their pairs."""
    import pandas as pd

    def tables(k):
        left = [(i, "hot" if i % 3 == 0 else None if i % 7 == 1 else f"k{i % 50}") for i in range(300 * k)]
        right = [(None if i == 5 else i, "hot" if i % 5 == 0 else None if i % 9 == 1 else f"k{i}") for i in range(60 * k)]
        return left, right

    met = []
    for k in (2, 10):
        left, right = tables(k)
        joined, info = best_key_join(spark.createDataFrame(left, "id long, path string"),
                                     spark.createDataFrame(right, "rid long, path string"), rows_per_task=10, sums=(["id"], ["rid"]))
        want = pd.DataFrame(left, columns=["id", "path"]).merge(pd.DataFrame(right, columns=["rid", "path"]), on="path")
        want = want.fillna({"path": "null"}).groupby("path").agg(n=("id", "size"), a=("id", "sum"), b=("rid", "sum"))
        got = joined.groupBy("path").agg(F.sum("n_rows").alias("n"), F.sum("sum_id").alias("a"), F.sum("sum_rid").alias("b")).collect()
        assert {r.path or "null": (r.n, r.a, r.b or 0) for r in got} == {r.Index: (r.n, r.a, r.b) for r in want.itertuples()}
        assert info.matched_rows == int(want["n"].sum())
        met.append(joined.count() / (len(left) + len(right)))
    assert met[1] < 1.5 * met[0] and met[1] < 1
