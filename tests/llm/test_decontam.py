"""Benchmark passages against a full edit-distance table."""

import numpy as np
import pytest
from .texts import DOCS

from lumen.llm import decontam as d

ITEMS = "item_id long, text string"


def least_edits(item: bytes, doc: bytes) -> int:
    """Least edits of the whole item against any part of the document."""
    text, at = np.frombuffer(doc, np.uint8), np.arange(len(doc) + 1)
    cost = np.zeros(len(doc) + 1, int)
    for c in item:
        step = cost + 1
        step[1:] = np.minimum(step[1:], cost[:-1] + (text != c))
        cost = np.minimum.accumulate(step - at) + at
    return int(cost.min())


def plain(t):
    p = d.plain([t or ""])
    return p.raw.tobytes()


def budget(m):
    return max(min(m * d.EDIT_PERCENT // 100, (m - d.Q) // d.Q), 0)


def brute(docs, items, part=True):
    """(document, item) pairs in which the whole item or one of its parts occurs within its budget."""
    out = set()
    for k, t in docs:
        x = plain(t)
        for i, s in items:
            y = plain(s).strip()
            if any(len(z) >= d.Q and least_edits(z, x) <= budget(len(z)) for z in [y, *(d.parts(y) if part else [])]):
                out.add((k, i))
    return out


@pytest.fixture(scope="module")
def found(spark, sf01):
    return d.op9_benchmark_passages(spark, sf01).collect()


@pytest.fixture(scope="module")
def items(spark, sf01):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()]


def test_query_spans_are_within_budget(found, texts, items):
    item = dict(items)
    for r in found:
        y = plain(item[r.item_id]).strip()
        own = plain(texts[r.doc_id][r.start:r.end])
        assert r.edits <= r.budget
        if r.whole:
            assert r.budget == budget(len(y)) and least_edits(y, own) == r.edits
        else:
            assert r.edits in {least_edits(z, own) for z in d.parts(y) if budget(len(z)) == r.budget}
    assert {(k, i) for k, t in texts.items() for i, s in items if s in t} <= {(r.doc_id, r.item_id) for r in found}


def test_query_finds_what_brute_force_finds(found, texts, items):
    hits = {r.doc_id for r in found}
    some = sorted(k for k, t in texts.items() if k in hits or k % 17 == 0)
    some = [k for k in some if len(texts[k]) < 4000][:90]
    want = brute([(k, texts[k]) for k in some], items)
    assert want == {(r.doc_id, r.item_id) for r in found if r.doc_id in some}


def test_edits(spark, items):
    rng = np.random.default_rng(2)
    letters = "abcdefghij klmno"
    docs = []
    for n in range(150):
        t = list(items[n % len(items)][1])
        for _ in range(int(rng.integers(0, 26))):
            j = int(rng.integers(0, len(t)))
            what = rng.integers(0, 3)
            c = letters[int(rng.integers(0, len(letters)))]
            t[j:j + (what != 1)] = [] if what == 0 else [c]
        before, after = ("".join(rng.choice(list(letters), int(rng.integers(0, 200)))) for _ in range(2))
        docs.append((n, before + "\n" + ("".join(t).upper() if n % 5 == 0 else "".join(t)) + after))
    got = d.occurrences(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    want = brute(docs, items, part=False)
    assert {(r.doc_id, r.item_id) for r in got if r.whole} == want
    assert 40 < len(want) < 150


def test_parts_overlap_and_cover(items):
    for _, t in items:
        y = plain(t).strip()
        parts = d.parts(y)
        assert bool(parts) == (len(y) >= 2 * d.LEAST_PART)
        at = [y.find(x) for x in parts]
        assert all(len(x) >= d.LEAST_PART or x == parts[-1] for x in parts) and at == sorted(at)
        assert not parts or (at[0] == 0 and parts[-1] == y[at[-1]:])
        assert all(b <= a + len(x) for a, b, x in zip(at, at[1:], parts))


def test_a_quoted_half_is_found(spark, items):
    long = [(i, t) for i, t in items if len(plain(t)) > 320]
    docs = []
    for n, (i, t) in enumerate(long * 3):
        words = t.split()
        a = [0, len(words) // 2, len(words) // 4][n // len(long)]
        docs.append((i * 10 + n // len(long), "Before it. " + " ".join(words[a:a + len(words) // 2 + 2]) + " After it."))
    got = {(r.doc_id, r.item_id) for r in d.occurrences(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(long) >= 3 and {(k, k // 10) for k, _ in docs} <= got
    kept = d.clean(spark.createDataFrame(docs + [(-1, "a clean text of other words")], DOCS), spark.createDataFrame(items, ITEMS))
    assert [r.doc_id for r in kept.collect()] == [-1]


def test_edges(spark, edge):
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "THREE"), (3, "here again and again!"), (4, "…"), (5, "xx"),
                                   (6, "here again and again!")], ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in d.occurrences(edge, bench).collect())
    assert got == [(4, 2)] * 3 + [(8, 3), (8, 6), (9, 3), (9, 6)]
    assert d.clean(edge, bench).count() == edge.count() - 5
    assert d.clean(edge, bench).columns == edge.columns
    none = spark.createDataFrame([], ITEMS)
    assert d.occurrences(edge, none).count() == 0 and d.clean(edge, none).count() == edge.count()
    assert d.occurrences(spark.createDataFrame([], DOCS), bench).count() == 0


def test_spans_count_code_points(spark):
    text = "İİ 🙂 – The Quick, BROWN fox jumps over it all. 🙂"
    docs, bench = spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(9, "quick brown fox jumps over")], ITEMS)
    r = d.occurrences(docs, bench).first()
    assert text[r.start:r.end] == "Quick, BROWN fox jumps over" and r.edits == 0


def test_many_items_in_blocks(spark, monkeypatch, texts, items, found):
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    got = d.occurrences(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, found))
