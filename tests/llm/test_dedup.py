"""Near duplicates against brute force over all pairs that share a shingle."""

import re
from collections import defaultdict

import numpy as np
import pytest
from .texts import DOCS

from lumen.llm import dedup, textvec
from lumen.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(texts, size):
    out = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").encode().lower())
        out[k] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(texts, size, percent=80):
    sets, at = sets_of(texts, size), defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    seen = set()
    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                if (b, a) not in seen:
                    seen.add((b, a))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                        ra, rb = sorted((find(a), find(b)))
                        root[rb] = ra
    return {k: (len(sets[k]), find(k)) for k in sets}


def check(df, texts, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute(texts, size)


def test_query_equals_brute_force(spark, sf01, texts):
    df = dedup.op5_near_duplicates(spark, sf01)
    rows = df.collect()
    assert len(rows) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 4)


def test_chains_and_hubs(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(120):  # edits of one text: near to the first, less so to each other
        w = list(base)
        for j in rng.choice(300, 9, replace=False):
            w[j] = f"e{i}_{j}"
        texts[i] = " ".join(w)
    for i in range(40):  # a chain: each text drifts from the last
        texts[200 + i] = " ".join(f"c{j}" for j in range(i * 8, i * 8 + 160))
    df = dedup.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS), size=4)
    check(df, texts, 4)


@pytest.mark.parametrize("many", [4, 0])
def test_open_buckets_in_tiles(spark, monkeypatch, many):
    """Copies of a missing original, many of them below the bound to each other; small tiles, forests."""
    monkeypatch.setattr(dedup, "TILE", 16)
    monkeypatch.setattr(dedup, "MANY", many)
    rng = np.random.default_rng(8)
    texts = {}
    for i in range(150):
        w = [f"w{j}" for j in range(200)]
        for j in rng.choice(200, int(rng.integers(2, 9)), replace=False):
            w[j] = f"e{i}_{j}"
        texts[i] = " ".join(w)
    want = brute(texts, 4)
    assert 3 < len({c for _, c in want.values()}) < 100
    check(dedup.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS), size=4), texts, 4)


def test_edges(spark, edge):
    rows = dedup.near_duplicates(edge, size=4).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == edge.count()
    assert (0, 0, 0, True) in got and (2, 0, 2, True) in got
    assert (3, 1, 3, True) in got and (4, 1, 4, True) in got
    assert (8, 3, 8, True) in got and (9, 3, 8, False) in got
    assert (None, 1, None, True) in got
    assert dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}


def test_words_and_hashes():
    texts = ["Ab c\tD", "", "x", "\n  ab  C d ", "é É"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = textvec.split(np.frombuffer(raw, np.uint8), off)
    assert textvec.word_bytes(w, np.arange(len(w.start))) == [b"ab", b"c", b"d", b"x", b"ab", b"c", b"d", "é".encode(), "É".encode()]
    assert w.first.tolist() == [0, 3, 3, 4, 7, 9]
    assert (w.hash[:3] == w.hash[4:7]).all() and len(set(w.hash.tolist())) == 6


def test_odd_sketch_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    off = np.array([0, 1000, 2000])
    x, y = dedup._sketch(dedup._minhash(np.concatenate([np.sort(a), np.sort(b)]), off))
    z = sum(bin(int(p ^ q)).count("1") for p, q in zip(x, y))
    n, k = dedup.SKETCH_LONGS * 64, dedup.BANDS * dedup.ROWS
    estimate = 1 + n / (4 * k) * np.log(1 - 2 * z / n)
    assert abs(estimate - 900 / 1100) < 0.12 and z <= dedup._sketch_bound()


def test_stage_keeps_rows_without_id(spark):
    from collections import Counter
    same, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, same), (2, same), (3, other), (None, same), (None, same), (None, None), (None, "")]
    out = dedup.stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter(map(tuple, out.collect())) == Counter([(1, same), *rows[2:]])
