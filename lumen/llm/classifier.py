"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text is four families of features, hashed to 2^SLOT_BITS slots: its words and
its word pairs, and the same for the shapes of its words (capitals, digits,
symbols, final marks, length, equality with the word before). A feature's value
is the root of its share in its family, so a text of any length has the same
norm, and an empty text has the constant feature alone. A score is the sigmoid
of a sparse dot product.

Training is FTRL-proximal with a learning rate for each slot and L1 and L2
terms. The training rows are dealt to CHUNKS learners by hash; in each epoch
every learner goes on from the common state, a row at a time in the order of
the hash, and the changes of its ``z`` and ``n`` are averaged over the learners
that touched the slot. At most SAMPLE labelled rows train (those of least
hash); all texts are scored.

Defined results: null and empty texts get the score of the constant feature;
repeated rows are scored each, repeated labels train each; null ids and null
labels never train; without labels (or of one kind only) the score is their
share, 0.5 if there are none; texts of any length are read whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.common import materialise, read

SLOT_BITS = 18
#: Labelled rows that train, at most; learners and passes.
SAMPLE, CHUNKS, EPOCHS = 8_192, 8, 4
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: Fixed by the contract.
FOLDS, KEEP = 5, 0.3

U = np.uint64
SLOTS = 1 << SLOT_BITS
BIAS = 0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, np.int64)
for _i, _c in enumerate(b".,;:!?\"')"):
    _MARK[_c] = _i + 1


def _shapes(w: textvec.Words) -> np.ndarray:
    """A hash of each word's shape."""
    def count(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(w.raw) + 1, np.int64)
        np.cumsum(kind[w.raw], out=total[1:])
        return total[w.end] - total[w.start]

    size = w.end - w.start
    upper, digit, symbol = count(_UPPER), count(_DIGIT), count(_SYMBOL)
    capitals = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper >= size, 2, 3)))
    same = np.zeros(len(size), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    code = np.searchsorted([2, 4, 8, 13, 25], size, "right")
    for part, base in ((capitals, 4), (np.minimum(digit, 2), 3), (np.minimum(symbol, 3), 4),
                       (_MARK[w.raw[w.end - 1]], 16), (same, 2)):
        code = code * base + part
    return textvec.mix(code.astype(U) + U(1))


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and values of the features of a batch of texts, in order of row and slot."""
    w = textvec.split(raw, off)
    rows = len(off) - 1
    follows = np.zeros(len(w.row), bool)
    follows[1:] = w.row[1:] == w.row[:-1]
    second = np.flatnonzero(follows)
    row, slot, value = [np.arange(rows)], [np.full(rows, BIAS)], [np.ones(rows)]
    for family, h in enumerate((w.hash, _shapes(w))):
        for pair in (0, 1):
            x = textvec.mix(h[second - 1] * U(0x2545F4914F6CDD1D) + h[second]) if pair else h
            at = w.row[second] if pair else w.row
            x = textvec.mix(x + U(2 * family + pair + 1)) >> U(64 - SLOT_BITS)
            key, n = np.unique(at.astype(np.int64) << SLOT_BITS | x.astype(np.int64), return_counts=True)
            r = key >> SLOT_BITS
            total = np.bincount(at, minlength=rows)
            row.append(r)
            slot.append(key & (SLOTS - 1))
            value.append(np.sqrt(n / total[r]))
    row, slot, value = np.concatenate(row), np.concatenate(slot), np.concatenate(value)
    key = row << SLOT_BITS | slot
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> SLOT_BITS, key[first] & (SLOTS - 1), np.add.reduceat(value, first) if len(key) else value


def vectors(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, slots and values of the texts in column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                row, slot, value = features(*textvec.buffers(part.column("text")))
                off = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.ListArray.from_arrays(off, pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(off, pa.array(value.astype(np.float32)))], [*keep, "slots", "vals"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, slots array<int>, vals array<float>")


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The regularised leader of the state: zero where the gradients do not exceed L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(z: np.ndarray, n: np.ndarray, slot: np.ndarray, value: np.ndarray, label: float) -> None:
    """One step of FTRL-proximal, in place."""
    zs, ns = z[slot], n[slot]
    w = weights(zs, ns)
    p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
    g = (p - label) * value
    more = ns + g * g
    z[slot] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
    n[slot] = more


def _learner(z0: np.ndarray, n0: np.ndarray):
    """Rows (slot, z, n): what a learner changed, for each of the chunks in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            at = np.flatnonzero(n != n0)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(z[at] - z0[at]), pa.array(n[at] - n0[at])],
                                              ["slot", "z", "n"])
        now = None
        for batch in batches:
            chunk = batch.column("chunk").to_pylist()
            label = batch.column("label").to_pylist()
            slots, vals = batch.column("slots"), batch.column("vals")
            for i, c in enumerate(chunk):
                if c != now:
                    if now is not None:
                        yield out()
                    now, z, n = c, z0.copy(), n0.copy()
                follow(z, n, slots[i].values.to_numpy(), vals[i].values.to_numpy().astype(np.float64), label[i])
        if now is not None:
            yield out()

    return run


def train(rows: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """State (z, n) after ``epochs`` over ``rows`` (chunk, ord, label, slots, vals).

    Only the state, 2^SLOT_BITS pairs of numbers, reaches the driver.
    """
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    dealt = rows.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "ord")
    for _ in range(epochs):
        d = (dealt.mapInArrow(_learner(z, n), "slot int, z double, n double")
             .groupBy("slot").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow())
        at = d.column("slot").to_numpy()
        z[at] = np.round(z[at] + d.column("z").to_numpy(), 9)
        n[at] = np.round(n[at] + d.column("n").to_numpy(), 9)
    return z, n


def held_out(key: str = "doc_id"):
    """The fold that never trains (a null id is in none)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(chunk, ord, label, slots, vals) of at most ``most`` labelled rows outside the held-out fold, least hash first."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .select("doc_id", F.col(label).cast("double").alias("label"),
                     F.xxhash64("doc_id", F.lit(17)).alias("ord")))
    n = known.count()
    if n > most:  # hashes are uniform: a little more than the share, then the bound is exact
        share = (most + 6 * most ** 0.5 + 16) / n
        known = known.where(F.col("ord") < int(-2**63 + min(1.0, share) * (2**64 - 1)))
        known = known.orderBy("ord", "doc_id", "label").limit(most)
    known = materialise(known, "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # SAMPLE rows at most
    return vectors(rows.withColumn("chunk", F.pmod("ord", F.lit(CHUNKS)).cast("int")), ("chunk", "ord", "label"))


def score_texts(docs: DataFrame, w: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every text; ``w`` has a fixed size."""
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                row, slot, value = features(*textvec.buffers(part.column("text")))
                total = np.bincount(row, w[slot] * value, minlength=part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(p)], [*keep, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = materialise(training_rows(docs, labels, label, most), "training")
    kinds = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(kinds) < 2:
        share = kinds.get(1.0, 0) / sum(kinds.values()) if kinds else 0.5
        scored = docs.select("doc_id", F.lit(share).alias("score"))
    else:
        scored = score_texts(docs, weights(*train(rows)))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
