"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document's set holds its distinct word shingles (64-bit hashes). One pass
over the texts draws ``BANDS * ROWS`` MinHash samples per set; groups of ROWS
samples are band keys, and all samples are folded into an odd sketch, a bitmap
of parities. The XOR of two odd sketches has a population count that estimates
the number of samples in which two sets differ, closely so for similar sets.

1. Documents with the same set form a class; only classes are compared.
2. Classes that share a band key meet in a bucket, and every member is paired
   with the bucket's leader, not with all others. The odd sketches of the
   samples drop pairs that can't be similar; the rest are confirmed on their
   full sets (``intersection / union``, in integers) and merge components.
3. What is left open are buckets whose members lie in several components.
   Members outside the bucket's largest component are compared with all others
   in tiles of bounded size, on odd sketches of the full sets: the population
   count of their XOR never exceeds the size of the symmetric difference, so a
   pair beyond the bound is certainly not linked. Pairs within it are
   confirmed on their full sets. A tile with very many such pairs hands out a
   forest of them and is compared again after the merge.

No link is lost but by the band keys and the sketch of the samples: at
similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^28 = 4e-7,
and the sketch's bound lies more than five standard deviations away. There is
no cap on buckets, members or partners, and no bucket emits all its pairs.

Defined results: null, empty or wordless texts have the empty set and are
linked with nothing; rows with one doc_id are one document; a null doc_id
belongs to no component (``component_id`` null, kept); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.bitmaps import Bitmap, bitmap
from lumen.llm.common import materialise, read
from lumen.llm.components import connected_components

BANDS, ROWS, SKETCH_LONGS = 28, 4, 8
#: Bits of the odd sketch of a full set.
SET_BITS = 2048
#: Similarity below which the sketch drops a pair, far under the wanted one.
SKETCH_SIMILARITY = 0.55
#: Members of a bucket that one side of a tile holds, about.
TILE = 1024
#: Pairs for each row of a tile from which on it hands out a forest.
MANY = 4

_SIGNATURE = "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>, parity binary"
_U = np.uint64


def _minhash(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of MinHash samples; sets must not be empty."""
    k = BANDS * ROWS
    salt, factor = textvec.stream(2, k), textvec.stream(3, k) | _U(1)
    out = np.empty((len(off) - 1, k), _U)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((sets ^ salt[i]) * factor[i], off[:-1])
    return out


def _sketch(samples: np.ndarray) -> np.ndarray:
    """Odd sketch of each row: bit j is the parity of the samples that hash to j."""
    bits = SKETCH_LONGS * 64
    at = (textvec.mix(samples + textvec.stream(4, samples.shape[1])) % _U(bits)).astype(np.int64)
    rows = len(samples)
    flat = np.bincount((at + np.arange(rows)[:, None] * bits).ravel(), minlength=rows * bits)
    odd = (flat.reshape(rows, SKETCH_LONGS, 64) & 1).astype(_U)
    return (odd << np.arange(64, dtype=_U)).sum(axis=2, dtype=_U)


def _parity(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Odd sketch of each full set, as rows of bytes."""
    rows = len(off) - 1
    at = (textvec.mix(sets + _U(7)) % _U(SET_BITS)).astype(np.int64) + np.repeat(np.arange(rows), np.diff(off)) * SET_BITS
    return np.packbits((np.bincount(at, minlength=rows * SET_BITS) & 1).astype(np.uint8).reshape(rows, SET_BITS), axis=1)


def _lists(x: np.ndarray) -> pa.Array:
    """A list column from the rows of a matrix of unsigned 64-bit numbers."""
    flat = pa.array(np.ascontiguousarray(x).ravel().view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set size, 128-bit fingerprint of the set, band keys and odd sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = textvec.stream(5, BANDS)
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                sets, off = textvec.shingles(textvec.split(*textvec.buffers(part.column("text"))), size)
                n = np.diff(off)
                some = np.flatnonzero(n)
                f = np.zeros((part.num_rows, 2), np.int64)
                bands = np.zeros((part.num_rows, BANDS), _U)
                sketch = np.zeros((part.num_rows, SKETCH_LONGS), _U)
                if len(some):
                    h = _minhash(sets, np.concatenate([off[:-1][some], off[-1:]]))
                    sketch[some] = _sketch(h)
                    key = np.broadcast_to(salt, (len(some), BANDS))
                    for r in range(ROWS):
                        key = textvec.mix(key * _U(0x2545F4914F6CDD1D) + h[:, r::ROWS])
                    bands[some] = key
                    for d in some.tolist():
                        f[d] = np.frombuffer(xxhash.xxh3_128_digest(sets[off[d]:off[d + 1]].tobytes()), np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()),
                                       _lists(bands), _lists(sketch), pa.array([x.tobytes() for x in _parity(sets, off)], pa.binary())],
                                      ["doc_id", "n", "f1", "f2", "bands", "sketch", "parity"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNATURE)


def shingle_sets(docs: DataFrame, size: int, wanted: Bitmap | None = None) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of its text; ``wanted``: ids that must not be left out.

    Texts are filtered where they are read, so none is shuffled. The bitmap may let others pass, which no pair asks for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pc.is_valid(batch.column("doc_id")))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                batch = batch.filter(pa.array(wanted.has(np.zeros(len(ids), np.int64), ids.view(_U))))
            for part in textvec.steps(batch, "text"):
                sets, off = textvec.shingles(textvec.split(*textvec.buffers(part.column("text"))), size)
                col = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), col], ["doc_id", "set"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set array<long>")


def _sketch_bound() -> int:
    """Largest XOR population count that a pair of SKETCH_SIMILARITY is expected to have."""
    bits, k = SKETCH_LONGS * 64, BANDS * ROWS
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * k * (1 - SKETCH_SIMILARITY))))


def _with_leader(members: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of a bucket's leader and its members that sizes and sketches allow."""
    lead = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("l"))
    lead = members.join(lead.select("key", F.col("l.rep").alias("rep")), ["key", "rep"], "left_semi")
    lead = lead.select("key", F.col("rep").alias("l"), F.col("n").alias("l_n"), F.col("sketch").alias("l_sketch"))
    diff = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("l_sketch")[i])) for i in range(SKETCH_LONGS))
    return (members.join(lead, "key")
            .where((F.col("rep") != F.col("l"))
                   & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")) & (diff <= _sketch_bound()))
            .select(F.least("rep", "l").alias("a"), F.greatest("rep", "l").alias("b")).distinct())


def _tiles(open_: DataFrame) -> DataFrame:
    """Rows of open buckets dealt to tiles.

    A bucket's members outside its largest component (side r) and inside it
    (side g) are cut into blocks; tiles are r x r and r x g. Members of one
    component are never compared, so g x g is left out.
    """
    sizes = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps"))
    most = most.where("comps > 1").select(
        "key", F.col("most.comp").alias("largest"), F.ceil(F.col("most.c") / TILE).cast("int").alias("g"),
        F.ceil((F.col("all") - F.col("most.c")) / TILE).cast("int").alias("r"))
    d = open_.join(most, "key").withColumn("inside", F.col("comp") == F.col("largest"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("g")).otherwise(F.col("r"))).cast("int")
    d = d.withColumn("block", block)
    r, g = F.sequence(F.lit(0), F.col("r") - 1), F.sequence(F.lit(0), F.col("g") - 1)
    with_r = lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"), F.lit("r").alias("kind"))
    tiles = F.when(F.col("inside"), F.transform(r, lambda x: F.struct(x.alias("i"), F.col("block").alias("j"), F.lit("g").alias("kind")))) \
        .otherwise(F.concat(F.transform(r, with_r),
                            F.transform(g, lambda x: F.struct(F.col("block").alias("i"), x.alias("j"), F.lit("g").alias("kind")))))
    return d.select("key", "rep", "comp", "n", "sketch", "parity", "inside", "block", F.inline(tiles))


def _tile_pairs(one: np.ndarray, two: np.ndarray, t: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Rows (x, y, difference per mille of what a link may have) that sizes and both sketches allow."""
    n, comp, sketch, parity, bound = t["n"], t["comp"], t["sketch"], t["parity"], _sketch_bound()
    found = []
    for at in range(0, len(one), 128):
        x = one[at:at + 128]
        far = np.zeros((len(x), len(two)), np.uint16)
        for c in range(sketch.shape[1]):
            far += np.bitwise_count(sketch[x, c][:, None] ^ sketch[two, c])
        p, q = np.nonzero((far <= bound) & (comp[x][:, None] != comp[two]))
        p, q = x[p], two[q]
        size = 100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])
        p, q = p[size], q[size]
        limit = (100 - percent) * (n[p] + n[q]) // (100 + percent)
        differ = np.bitwise_count(parity[p] ^ parity[q]).sum(axis=1, dtype=np.int64)
        ok = differ <= limit
        found.append(np.stack([p[ok], q[ok], differ[ok] * 1000 // np.maximum(limit[ok], 1)]))
    return np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)


def _forest(pairs: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """The likeliest pairs that join components."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c
    keep = []
    for k in np.argsort(pairs[2], kind="stable").tolist():
        u, v = find(int(comp[pairs[0, k]])), find(int(comp[pairs[1, k]]))
        if u != v:
            root[max(u, v)] = min(u, v)
            keep.append(k)
    return pairs[:, keep]


def _compare(tiles: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(key, a, b, cut): pairs of different components in each tile that sketches allow; ``cut``: more were found.

    Tiles follow each other in sorted partitions; a task holds one batch and
    the tile that it breaks off in.
    """
    names = ["key", "i", "j", "kind"]

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        t = t.combine_chunks()
        out = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "kind", "rep", "comp", "n", "inside", "block")}
        fixed = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), _U).reshape(t.num_rows, k)
        out["parity"] = fixed("parity", SET_BITS // 64)
        out["sketch"] = t.column("sketch").combine_chunks().flatten().to_numpy().view(_U).reshape(t.num_rows, SKETCH_LONGS)
        return out

    def compare(t: dict[str, np.ndarray], a: int, b: int) -> tuple[np.ndarray, bool]:
        if t["kind"][a] == 1:
            one = ~t["inside"][a:b]
            two = ~one
        else:
            one, two = t["block"][a:b] == t["i"][a], t["block"][a:b] == t["j"][a]
        pairs = _tile_pairs(a + np.flatnonzero(one), a + np.flatnonzero(two), t, percent)
        cut = not whole and pairs.shape[1] > MANY * (b - a)
        return _forest(pairs, t["comp"]) if cut else pairs, cut

    def done(t: pa.Table, rest: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Pairs of the tiles that are complete, and the rows of the last one unless no rows follow."""
        x = arrays(t)
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([x[c][1:] != x[c][:-1] for c in names], axis=0)
        edge = np.append(np.flatnonzero(new), t.num_rows)
        if rest:
            edge = edge[:-1]
        cols = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, bool)]]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            pairs, cut = compare(x, a, b)
            u, v = x["rep"][pairs[0]], x["rep"][pairs[1]]
            for c, y in zip(cols, (np.full(len(u), x["key"][a]), np.minimum(u, v), np.maximum(u, v), np.full(len(u), cut))):
                c.append(y)
        return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], ["key", "a", "b", "cut"]), t.slice(int(edge[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if t.num_rows:
                out, held = done(t, True)
                yield out
        if held is not None and held.num_rows:
            yield done(held, False)[0]
    sorted_ = tiles.withColumn("kind", F.when(F.col("kind") == "g", 1).otherwise(0)).repartition(*names).sortWithinPartitions(*names)
    return sorted_.mapInArrow(run, "key long, a long, b long, cut boolean")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    ``size`` words a shingle, ``percent`` the least similarity of a link.
    """
    sig = materialise(signatures(docs, size), "signatures")
    first = [F.first(c).alias(c) for c in ("n", "bands", "sketch", "parity")]
    classes = materialise(sig.where("n > 0 and doc_id is not null").groupBy("f1", "f2")
                          .agg(F.min("doc_id").alias("rep"), *first), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "rep")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = materialise(keys.join(shared, "key"), "buckets")
    live = materialise(classes.join(met.select("rep").distinct(), "rep", "left_semi")
                       .select("rep", "n", "sketch", "parity"), "live")
    sets = materialise(shingle_sets(docs, size, bitmap(live.select(F.lit(0).alias("part"), "rep"), "part", "rep")), "sets")

    pairs = _with_leader(met.join(live.select("rep", "n", "sketch"), "rep"), percent)
    links = materialise(_confirm(pairs, sets, percent), "links")
    comps = connected_components(links)
    whole, again = False, met
    while True:
        member = again.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        spread = (member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"))
        open_ = materialise(member.join(spread, "key"), "open")
        pairs = materialise(_compare(_tiles(open_.join(live, "rep")), percent, whole), "pairs")
        links = materialise(_confirm(pairs.select("a", "b").distinct(), sets, percent), "links")
        merged = not links.isEmpty()
        if merged:
            comps = _merge(comps, links)
        cut = pairs.where("cut").select("key").distinct()
        if cut.isEmpty():
            break
        again = open_.join(cut, "key", "left_semi").select("key", "rep")
        whole = not merged
    # documents without a set share one fingerprint; they and those without an id stay out of the join
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    member = sig.where(~alone).select("doc_id", "n", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    member = member.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    member = member.unionByName(sig.where(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return member.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links join old components, not documents."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    top = connected_components(ends)
    new = top.join(comps, "node", "left_anti")
    old = comps.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left")
    return materialise(old.select("node", F.coalesce("next", "comp").alias("comp")).union(new.select("node", "comp")), "comps")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates (five-word shingles); all without doc_id."""
    kept = near_duplicates(docs, size=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    # null equals nothing in a join: rows without an id go beside it, and never meet in one task
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


ORACLE_SQL: dict[str, str] = {}
