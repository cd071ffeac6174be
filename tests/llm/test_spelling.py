"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumen.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows, length=6, least=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(words):
    near = {w: [] for w in words}
    cut = {}
    for w in words:  # words that share a form with one character cut are the only ones to compare
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} if len(w) < 200 else {w}:
            cut.setdefault(k, set()).add(w)
    for group in cut.values():
        for a in group:
            for b in group:
                if b not in near[a] and one_edit(a, b):
                    near[a].append(b)
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def got(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


def test_whole_table(spark, sf01, texts):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(rows))
    have = spelling.op11_spelling_variants(spark, sf01)
    assert have.columns == COLUMNS
    assert dict(have.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint",
                                 "n_near": "bigint", "form_n": "bigint"}
    assert got(have) == want
    assert sum(1 for r in want if r[1]) > 20 and sum(1 for r in want if r[4]) > 100


WORDS = st.dictionaries(st.text("abé", min_size=6, max_size=9), st.integers(5, 700), min_size=1, max_size=60)


@settings(max_examples=2, deadline=None)
@given(WORDS)
def test_dense_vocabularies(spark, words):
    """Few letters: runs of equal characters, edits at both ends, chains of forms."""
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.group_spellings(df)) == brute(words)


def test_edits_ties_and_chains(spark):
    words = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "baaaaa": 25, "abaaaa": 25, "aaaaab": 24, "ÿbcdef": 5, "abcdef": 30,
             "abcdefg": 30, "xabcdef": 30, "acbdef": 9, "lonely": 7, "x" * 50000: 5, "x" * 49999: 25, "x" * 49998 + "yx": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    have = got(spelling.group_spellings(df))
    assert _long(have, words)


def _long(have, words):
    """Brute force with the long words compared one by one."""
    near = {w: [b for b in words if one_edit(w, b)] for w in words}
    for w, form, root, n, n_near, form_n in have:
        assert n == words[w] and n_near == len(near[w]), w[:20]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        want = best if best and words[best] >= 5 * n else None
        assert form == want and form_n == (words[want] if want else None)
        assert root == w if form is None else words[root] >= 5 * n
    return len(have) == len(words)


def test_edges(spark, edge):
    text = "Colour colour COLOUR colour colour colours × ÷÷÷÷÷÷÷ café-crème l'été " * 5
    docs = edge.withColumn("text", F.concat_ws(" ", "text", F.lit(text)))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    have = spelling.group_spellings(spelling.vocabulary(docs))
    assert {r[0]: r[3] for r in got(have)} == {k: v for k, v in counted(rows).items()}
    assert got(spelling.group_spellings(spelling.vocabulary(docs.limit(0)))) == set()
    plain = spelling.vocabulary(edge)
    assert {tuple(r) for r in plain.collect()} == set(counted([tuple(r) for r in edge.select("doc_id", "text").collect()]).items())


@pytest.mark.parametrize("n", [1, 3, 7])
def test_crc_of_many_runs(n):
    import numpy as np
    data = [b"a" * k for k in range(40)] * n + [b"x" * 5000]
    raw = np.frombuffer(b"".join(data), np.uint8)
    end = np.cumsum([len(d) for d in data])
    start = end - [len(d) for d in data]
    state = spelling._crc(raw, start, end, np.full(len(data), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    assert state.tolist() == [zlib.crc32(d) for d in data]


@pytest.mark.parametrize("shipped", [0, 4 << 20])
def test_no_broadcast_by_estimate(spark, monkeypatch, shipped):
    """Every prefix of every word was broadcast: estimates tell an Arrow stage's rows by the words' file. Only counted states may be."""
    words = {f"{a}{b}{'xyz' * k}": 5 + 40 * k for a in ("stone", "stane", "ston") for b in "abcdefgh" for k in (1, 2)}
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialise(df, name)

    materialise = spelling.materialise
    monkeypatch.setattr(spelling, "materialise", seen)
    monkeypatch.setattr(spelling, "SHIPPED_BYTES", shipped, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        df = spelling.group_spellings(materialise(spark.createDataFrame(list(words.items()), "word string, n long"), "given"))
        plans.append(("result", df._jdf.queryExecution().executedPlan().toString()))
        assert got(df) == brute(words)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    by = {name for name, plan in plans if "Broadcast" in plan}
    assert by == ({"states"} if shipped else set()) and len(plans) > 8
