"""Revisit resolution and sharding against plain loops."""

import random
import zlib
from collections import Counter

import pytest
from .texts import DOCS
from pyspark.sql import functions as F

from lumen.llm import sharding, warc
from tools.oracle_check import duck, rows_of

RECORDS = ("record_id long, url string, captured long, kind string, status int, truncated boolean, digest string, "
           "headers map<string,string>, found string")


def test_revisit_oracle(spark, sf01):
    df, cur = warc.op3_revisits(spark, sf01), duck(sf01).execute(warc.ORACLE_SQL["op3_revisits"])
    cols = [d[0] for d in cur.description]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(cols, cur.fetchall()) and len({r[-1] for r in got}) >= 1


@pytest.mark.parametrize("url, want", [
    ("HTTP://www.A.com:80/x/?b=2&utm_source=q&a=1#f", "a.com/x?a=1&b=2"), ("https://u@a.com/index.html", "a.com"),
    ("https://a.com/X//", "a.com/X"), ("https://a.com", "a.com"), (" a.com/B ", "a.com/b"), ("", ""), (None, None),
    ("https://a.com:8080/?&", "a.com:8080")])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_revisits_equal_a_loop(spark):
    r = random.Random(3)
    rows = []
    for i in range(3000):  # one URL holds a third of all rows, with many equal times
        url = "http://hot.example/" if r.random() < 0.34 else r.choice([f"http://a{r.randint(0, 60)}.example/p", None])
        kind = r.choice(["response", "revisit"])
        tag = r.choice([None, '"a"', 'W/"a"', '"b"'])
        h = r.choice([None, {}]) if tag is None else {"ETag": tag, "Content-Type": kind, "date": str(i)}
        rows.append((i, url, r.choice([None, *range(40)]), kind, r.choice([200, 200, 404, None]), r.choice([None, False, True]), f"d{i}", h, "x"))
    rows += rows[:5]
    got = warc.resolve(spark.createDataFrame(rows, RECORDS).repartition(5)).collect()
    full = [x for x in rows if x[3] == "response" and x[4] == 200 and not x[5] and x[1] and x[2] is not None]
    want = []
    for x in rows:
        if x[3] != "revisit":
            continue
        old = [y for y in full if y[1] == x[1] and x[2] is not None and y[2] < x[2]]
        y = max(old, key=lambda y: (y[2], y[0])) if old else None
        new = {k.lower(): v for k, v in (x[7] or {}).items()}
        if y is None:
            want.append((x[0], "no_response", None, None, new))
            continue
        prior = {k.lower(): v for k, v in (y[7] or {}).items()}
        bare = lambda t: t.removeprefix("W/") if t else t
        verdict = "no_validator" if "etag" not in new else "resolved" if bare(new["etag"]) == bare(prior.get("etag")) else "modified"
        ok = verdict != "modified"
        want.append((x[0], verdict, y[0], y[6] if ok else None,
                     {**prior, **{k: v for k, v in new.items() if k in warc.PERMITTED}} if ok else new))
    order = lambda z: sorted(z, key=str)
    assert order((g.record_id, g.verdict, g.response_id, g.digest, dict(sorted(g.headers.items()))) for g in got) == \
        order((*w[:4], dict(sorted(w[4].items()))) for w in want)
    assert warc.resolve(spark.createDataFrame([], RECORDS)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 17, 100, 1000, 4097])
def test_permutation_is_a_bijection_and_inverts(spark, n):
    d = spark.range(n).withColumn("p", sharding.permute(F.col("id"), n)).withColumn("back", sharding.unpermute(F.col("p"), n))
    rows = d.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 100:  # a shuffle, and another one with another key
        assert sum(r.p == r.id for r in rows) < n / 10
        other = spark.range(n).select(sharding.permute(F.col("id"), n, key=5).alias("p")).collect()
        assert sum(a.p == b.p for a, b in zip(rows, other)) < n / 10


def test_sharding_query(spark, sf01, texts):
    rows = sharding.op2_feistel_shards(spark, sf01).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    order = sorted(texts)
    for r in rows:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
        assert order[r.row_number] == r.doc_id and r.position == r.slot * 8 + r.shard
    assert [tuple(r) for r in sharding.op2_feistel_shards(spark, sf01).orderBy("doc_id").collect()] == \
        [tuple(r) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_sharding_edges(spark, edge, tmp_path):
    d = edge.withColumn("size", F.length("text"))
    out = sharding.shard(d.drop("rep"), [F.col("doc_id"), F.col("size")]).collect()
    assert sorted(r.position for r in out) == list(range(edge.count()))
    assert sharding.shard(spark.createDataFrame([], DOCS), [F.col("doc_id")]).count() == 0
