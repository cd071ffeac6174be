"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumen.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, support=100, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i:i + k])] += 1
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= 100 * c[p[i:j]]}
        got = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                got.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def got(df):
    return {tuple(r) for r in df.collect()}


def test_whole_table(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows)
    have = collocations.op12_phrase_collocations(spark, sf01)
    assert have.columns == COLUMNS
    assert [t for _, t in have.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert got(have) == want and len(want) > 50


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_give_the_same_phrases(spark, sf01, shards):
    """Low support and uneven shards, a third of the rows in one: the union of the shards loses no phrase."""
    d = spark.read.parquet(f"{sf01}/documents.parquet").where("lang <> 'en'").select("lang", "text", "doc_id")
    rows = [(r.lang, r.text) for r in d.collect()]
    shard = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id"))
    have = collocations.collocations(d, support=20, top=500, shards=shards, shard=shard)
    assert got(have) == brute(rows, 20, 500)


def test_phrases_that_one_shard_holds(spark):
    """Locally frequent in a small shard only, spread thinly over all, inside a longer one, over a break."""
    rows = ([("en", "alpha beta gamma")] * 100 + [("en", f"x{i} delta epsilon. zeta") for i in range(120)]
            + [("en", "delta, epsilon")] * 90 + [(None, "Alpha\tBETA  gamma")] * 101 + [("de", "a a a a a a")] * 40
            + [("en", "É é É é")] * 100 + [("fr", "n'importe quoi ; n'importe quoi")] * 55)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for shard in (F.xxhash64("text"), F.length("text")):
        assert got(collocations.collocations(df, shard=shard)) == brute(rows)
    assert {r[2] for r in brute(rows) if r[0] == "en"} >= {"alpha beta gamma", "delta epsilon"}


def test_edges(spark, edge):
    d = edge.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x")).unionByName(
        edge.withColumn("lang", F.lit("y")))
    rows = [tuple(r) for r in d.select("lang", "text").collect()]
    assert got(collocations.collocations(d, support=2)) == brute(rows, 2)
    assert got(collocations.collocations(d.limit(0))) == set()
    assert got(collocations.collocations(d.withColumn("text", F.lit(None).cast("string")))) == set()


def test_exact_products():
    """1000 * a * n and l * r pass 64 bits; the decimals of the score hold them."""
    a, n, left, right = 10**12, 4 * 10**13, 2 * 10**12, 10**12
    assert 1000 * a * n > 2**63 and 1000 * a * n < 10**38 and 1000 * a * n // (left * right) < 2**63


def test_a_task_adds_up_its_counts(monkeypatch):
    """A phrase is one row of a task, however many steps of text it comes in; with room for few, the sums are the same."""
    class All:
        def has(self, shard, gram):
            return np.ones(len(gram), bool)

    batches = [pa.record_batch([pa.array([f"a b {i} a b"] * 20), pa.array(["en"] * 20), pa.array([0] * 20, pa.int32())],
                               ["text", "lang", "shard"]) for i in range(6)]

    def rows():
        return [r for b in collocations._exact(All())(iter(batches)) for r in b.to_pylist()]
    once = rows()
    assert len(once) == len({(r["lang"], r["phrase"]) for r in once})
    assert {r["phrase"]: r["n"] for r in once}["a b"] == 240
    monkeypatch.setattr(collocations, "HELD", 4)
    total = Counter()
    for r in rows():
        total[r["phrase"]] += r["n"]
    assert total == {r["phrase"]: r["n"] for r in once}


@pytest.mark.parametrize("parts", [2, 24])
def test_spelled_rows_do_not_grow_with_the_tasks(spark, parts):
    """A phrase that every task holds is spelled where its slot is, not by each task."""
    d = spark.createDataFrame([("en", 0, i, f"red green blue {i}") for i in range(400)], "lang string, shard int, slot int, text string")
    d = d.repartition(parts).select("lang", "text", "shard", "slot")
    first = d.mapInArrow(collocations._local(collocations._words), collocations._LOCAL).groupBy("gram").agg(
        F.min("slot").alias("slot"), F.sum("n").alias("n")).where("n >= 400")
    rows = collocations.spelled(d, first).collect()
    assert sorted(r.phrase for r in rows) == ["blue", "green", "red"]


def test_counts_of_shards_that_do_not_report(spark):
    """Phrases just above the support, frequent in one shard and thin in the others, are counted there as well."""
    rows = [("en", f"deep sea {i}", 0) for i in range(70)] + [("en", f"deep sea z{i}", 1 + i % 3) for i in range(31)]
    rows += [("en", f"far hill {i}", 0) for i in range(80)] + [("en", f"far hill z{i}", 1 + i % 3) for i in range(19)]
    rows += [("en", " ".join(f"w{i}x{j}" for j in range(20)), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string, s int").repartition(6)
    have = got(collocations.collocations(df, shard=F.col("s")))
    assert have == brute([r[:2] for r in rows]) and {(r[2], r[3]) for r in have} == {("deep sea", 101)}
