"""Quality classifier: features and steps against plain code, held-out accuracy, edges."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.llm import classifier as C
from lumen.llm import textvec


def test_steps_are_ftrl_proximal():
    """A learner of dictionaries, slot by slot as published, against the vectorised steps."""
    rng = np.random.default_rng(3)
    z, n = np.zeros(C.SLOTS), np.zeros(C.SLOTS)
    pz, pn = {}, {}

    def weight(i):
        a, b = pz.get(i, 0.0), pn.get(i, 0.0)
        return 0.0 if abs(a) <= C.L1 else -(a - math.copysign(C.L1, a)) / ((C.BETA + math.sqrt(b)) / C.ALPHA + C.L2)

    for _ in range(200):
        slot = rng.choice(40, size=6, replace=False)
        value, label = rng.uniform(0.1, 1, 6), float(rng.integers(2))
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(slot, value))))
        for i, v in zip(slot.tolist(), value.tolist()):
            g, w = (p - label) * v, weight(i)
            s = (math.sqrt(pn.get(i, 0.0) + g * g) - math.sqrt(pn.get(i, 0.0))) / C.ALPHA
            pz[i], pn[i] = pz.get(i, 0.0) + g - s * w, pn.get(i, 0.0) + g * g
        C.follow(z, n, slot, value, label)
    assert all(abs(z[i] - pz[i]) < 1e-9 and abs(n[i] - pn[i]) < 1e-9 for i in pz)
    w = C.weights(z, n)
    assert all(abs(w[i] - weight(i)) < 1e-9 for i in range(40)) and not w[40:].any()


def test_features_are_shares_of_their_family(spark):
    """Each family has the norm of one, whatever the length; order and repetition are seen by the pairs."""
    texts = ["a b a b c", "", "one", "b a b a c", "x " * 5000, "THE!! of*** 12 the"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    row, slot, value = C.features(raw, off)
    assert (np.diff(row << C.SLOT_BITS | slot) > 0).all()
    norm = np.bincount(row, value ** 2, minlength=len(texts))
    for i, t in enumerate(texts):
        n = len(t.split())
        assert norm[i] == pytest.approx(1 + (n > 0) * 2 + (n > 1) * 2, abs=1e-6) or norm[i] >= 1 + (n > 0) * 2 + (n > 1) * 2
    pick = lambda i: dict(zip(slot[row == i].tolist(), value[row == i].tolist()))
    assert pick(1) == {C.BIAS: 1.0}
    assert pick(0) != pick(3)  # the same words in another order
    same = [C.features(*_one(t)) for t in ("Quality TEXT here", "quality text here")]
    words = [set(s[1].tolist()) for s in same]
    assert len(words[0] & words[1]) >= 1 + 3 + 2 and words[0] != words[1]  # words fold case, shapes see it


def _one(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_scores_are_sparse_dot_products(spark):
    """Spark's scores against a plain sum of counts over hashed words, pairs and shapes."""
    texts = ["some plain words, and some more.", "ALL*** CAPS!! | here", "", None, "word " * 300, "x" * 100000]
    w = np.random.default_rng(0).normal(size=C.SLOTS)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in C.score_texts(df, w).collect()}
    for i, t in enumerate(texts):
        s = w[C.BIAS]
        if t and t.split():
            words = textvec.split(*_one(t))
            for family, h in enumerate((words.hash, C._shapes(words))):
                for pair in (0, 1):
                    keys = h.tolist() if not pair else [
                        int(textvec.mix(np.array([(a * 0x2545F4914F6CDD1D + b) % 2**64], np.uint64))[0]) for a, b in zip(h.tolist(), h.tolist()[1:])]
                    slots = [int(textvec.mix(np.array([(k + 2 * family + pair + 1) % 2**64], np.uint64))[0]) >> (64 - C.SLOT_BITS) for k in keys]
                    for x in set(slots):
                        s += w[x] * math.sqrt(slots.count(x) / len(slots))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, s)))), abs=1e-4), i


def test_held_out_accuracy(spark, sf01):
    d = C.op13_quality_classifier(spark, sf01)
    assert d.columns == ["doc_id", "held_out", "score", "predicted"]
    assert [t for _, t in d.dtypes] == ["bigint", "boolean", "double", "int"]
    rows = {r.doc_id: r for r in d.collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id").collect()}
    assert set(rows) == docs
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    test = [(rows[k].score, y) for k, y in label.items() if k in rows and rows[k].held_out]
    pos, neg = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.95 and len(neg) >= 5
    assert sum((s >= 0.3) == y for s, y in test) / len(test) > 0.9


def test_held_out_labels_and_other_columns_change_nothing(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    a = {r.doc_id: r.score for r in C.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))) \
                    .withColumn("text", F.lit("clash")).withColumn("label", F.lit(3)).withColumn("ord", F.lit(1))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("score", F.lit(9)).repartition(7)
    b = {r.doc_id: r.score for r in C.classify(other, flipped).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_edges(spark, edge):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 7), (4, 0), (4, 0)], "doc_id long, quality int")
    out = C.classify(edge, labels).collect()
    assert len(out) == edge.count() and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1  # null, empty and blank texts
    assert next(r for r in out if r.doc_id is None).held_out is False
    assert C.classify(edge.limit(0), labels).count() == 0
    assert {(r.score, r.predicted) for r in C.classify(edge, labels.limit(0)).collect()} == {(0.5, 1)}
    assert {(r.score, r.predicted) for r in C.classify(edge, labels.where("quality = 0")).collect()} == {(0.0, 0)}


def test_bound_of_the_training_rows(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = C.training_rows(docs, labels, "quality", 100).collect()
    allowed = sorted(r.ord for r in C.training_rows(docs, labels, "quality", 10**6).collect())
    assert sorted(r.ord for r in rows) == allowed[:100] and {r.chunk for r in rows} == set(range(C.CHUNKS))
