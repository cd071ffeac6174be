"""A1-A5: F1, macro-F1, policies, exact AUC (against brute force) and its properties."""

import random

import pytest
from pyspark.sql import functions as F

from lumen.operators import metrics as M


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    if not pos or not neg:
        return None
    win = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return win / (len(pos) * len(neg))


def _scores(seed, groups=4, n=300, levels=25):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(n):
            y = 1 if rnd.random() < 0.3 else 0
            rows.append((g, i, y, rnd.randint(0, levels) + (3 if y else 0)))
    rows += [(99, i, 0, i % 5) for i in range(20)]  # one class -> null
    return rows


@pytest.mark.parametrize("kw", [dict(buckets=1), dict(buckets=3), dict(buckets=64), dict(),
                                dict(rows_per_bucket=2, max_fanout=3)])
def test_auc_equals_brute_force(spark, kw):
    rows = _scores(7)
    df = spark.createDataFrame(rows, "g int, i int, y int, s int")
    got = {r["g"]: r["auc"] for r in M.auc_by(df, ["g"], "y", "s", **kw).collect()}
    for g in set(r[0] for r in rows):
        ys = [r[2] for r in rows if r[0] == g]
        ss = [r[3] for r in rows if r[0] == g]
        exp = brute_auc(ys, ss)
        assert (got[g] is None) == (exp is None)
        if exp is not None:
            assert got[g] == pytest.approx(exp, abs=1e-12)


def test_auc_properties(spark):
    df = spark.createDataFrame(_scores(11), "g int, i int, y int, s int").where("g < 99")
    base = {r["g"]: r["auc"] for r in M.auc_by(df, ["g"], "y", "s").collect()}
    mono = {r["g"]: r["auc"] for r in M.auc_by(df.withColumn("s", F.exp(F.col("s") / 7.0) * 3 + 1),
                                               ["g"], "y", "s").collect()}
    neg = {r["g"]: r["auc"] for r in M.auc_by(df.withColumn("s", -F.col("s")), ["g"], "y", "s").collect()}
    for g in base:
        assert mono[g] == pytest.approx(base[g], abs=1e-12)
        assert base[g] + neg[g] == pytest.approx(1.0, abs=1e-12)


def test_auc_same_under_repartitioning(spark):
    df = spark.createDataFrame(_scores(3), "g int, i int, y int, s int")
    a = sorted(M.auc_by(df.repartition(1), ["g"], "y", "s").collect())
    b = sorted(M.auc_by(df.repartition(16, "i"), ["g"], "y", "s").collect())
    assert a == b


def test_f1_and_macro(spark):
    rows = [(c, gt, pr) for c in range(3) for gt, pr in [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)]]
    rows += [(3, 0, 0)]  # no positives at all -> F1 0 (zero_division=0)
    df = spark.createDataFrame(rows, "c int, gt int, pred int")
    per = {r["c"]: r["f1"] for r in M.f1_by(df, ["c"]).collect()}
    assert per[0] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1)) and per[3] == 0.0
    assert all(0.0 <= v <= 1.0 for v in per.values())
    macro = M.macro_f1(M.f1_by(df, ["c"])).first()["macro_f1"]
    assert macro == pytest.approx(sum(per.values()) / 4)
    same = spark.createDataFrame([(0, 1, 1), (0, 0, 0)], "c int, gt int, pred int")
    assert M.f1_by(same, ["c"]).first()["f1"] == 1.0


def test_policies(spark):
    items = spark.createDataFrame(
        [(1, [(0, 1, 1), (1, 0, -1)]), (2, [(0, 1, 0), (1, 1, 1)]), (3, [(0, 0, -1), (1, 0, 0)])],
        "item int, answers array<struct<condition_id:int, gt:int, pred:int>>")
    per, macro = M.policy_f1(items)
    got = {(r["policy"], r["condition_id"]): (r["n_rows"], r["tp"], r["fp"], r["fn"]) for r in per.collect()}
    assert got[("drop_ambiguous", 0)] == (1, 0, 0, 1)  # only item 2 survives
    assert got[("ambiguous_to_negative", 0)] == (3, 1, 0, 1)
    m = {r["policy"]: r["macro_f1"] for r in macro.collect()}
    assert set(m) == {"drop_ambiguous", "ambiguous_to_negative"}
    empty = spark.createDataFrame([(1, [(0, 1, -1)])], "item int, answers array<struct<condition_id:int, gt:int, pred:int>>")
    per2, macro2 = M.policy_f1(empty)
    assert per2.where("policy = 'drop_ambiguous'").count() == 0
    assert {r["policy"]: r["macro_f1"] for r in macro2.collect()}["drop_ambiguous"] == 0.0
