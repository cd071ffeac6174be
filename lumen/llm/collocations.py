"""Phrase collocations by SON partitioning.

The corpus is dealt into at most SHARDS shards. Every shard is mined completely
at the support that is its share: with ``w`` of the ``W`` words of a language a
phrase is locally frequent when ``f * W >= support * w``, so a phrase of global
support is locally frequent in one shard at least. Where it is, its count is
known; phrases whose shard counts do not yet prove that they cannot reach the
support are then counted in their other shards, exactly.

A shard is mined level by level (words, pairs, longer phrases), each level only
where the level below is locally frequent. A shard spans any number of tasks:
tasks count, Spark adds up the counts of a (shard, phrase). What one level tells
the next are bitmaps of fixed size; a bit set by chance only adds a candidate.
Phrases are known by 64-bit hashes of language and words. Counts tell, of each
hash, the least slot (hash of a text) that holds it; only texts of that slot
spell it, so spelled rows grow with the phrases, not with the tasks.

Defined results: null and empty texts have no words; a null language is
``und``; repeated rows count again; ties in score and count are ordered by the
bytes of the phrase; a text without gaps is one word, whatever its length; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.bitmaps import Bitmap, bitmap
from lumen.llm.common import materialise, read

#: Fixed by the contract.
SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Shards: few, so that the local support stays well above one; each spans many tasks.
SHARDS = 4
#: Phrases that a task holds while it spells them, about.
HELD = 1 << 18
#: Slots of texts: so many that those of one slot are copies, as a rule.
SLOTS = (1 << 31) - 1
#: Slices in which a language's phrases are ranked first.
SLICES = 64

U = np.uint64
_FACTOR = U(0x2545F4914F6CDD1D)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _BREAK.copy()
_GAPS[[0x20, 0x09]] = True


class _Step:
    """Words of a step of texts: hashes, whether the next word is in the same piece, language and shard."""

    def __init__(self, part: pa.RecordBatch):
        raw, off = textvec.buffers(part.column("text"))
        self.w = w = textvec.split(raw, off, _GAPS)
        self.langs = part.column("lang").dictionary_encode()
        code = self.langs.indices.to_numpy(zero_copy_only=False)
        shard = part.column("shard").to_numpy(zero_copy_only=False)
        seeds = np.array([int.from_bytes(_digest(x), "little") for x in self.langs.dictionary.to_pylist()], U)
        self.lang, self.shard = code[w.row], shard[w.row]
        self.slot = None
        if "slot" in part.schema.names:
            self.slot = part.column("slot").to_numpy(zero_copy_only=False)[w.row]
        self.seed = seeds[self.lang] if len(w.row) else np.zeros(0, U)
        piece = np.cumsum(_BREAK[raw])
        n = len(w.start)
        self.next = np.zeros(n, bool)
        if n > 1:
            self.next[:-1] = (w.row[1:] == w.row[:-1]) & (piece[w.start[1:]] == piece[w.start[:-1]])

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: the first words of the phrases, and the phrases' hashes."""
        h, at, whole = self.w.hash, np.arange(len(self.w.hash)), self.w.hash
        yield 1, at, textvec.mix(whole ^ self.seed)
        for k in range(2, most + 1):
            inside = self.next[at + k - 2]
            at, whole = at[inside], whole[inside]
            whole = textvec.mix(whole * _FACTOR + h[at + k - 1] + U(k))
            yield k, at, textvec.mix(whole ^ self.seed[at])

    def keep(self, at: np.ndarray, k: int, pairs: np.ndarray) -> np.ndarray:
        """Which phrases of ``k`` words at ``at`` have only pairs that are marked."""
        ok = np.ones(len(at), bool)
        for i in range(k - 1):
            ok &= pairs[at + i]
        return ok


def _digest(x: str) -> bytes:
    import hashlib
    return hashlib.blake2b(x.encode(), digest_size=8).digest()


def _local(found: Callable[[_Step], Iterator[tuple[np.ndarray, np.ndarray]]]):
    """Rows (lang, shard, gram, n, slot) of what ``found`` yields (first words, hashes), added up in each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                s = _Step(part)
                for at, gram in found(s):
                    if not len(at):
                        continue
                    # the hash holds the language; shards are told apart by a second key
                    shard = s.shard[at]
                    order = np.lexsort((gram, shard)) if shard.min() != shard.max() else np.argsort(gram)
                    g, h = gram[order], shard[order]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
                    first = np.flatnonzero(new)
                    lang = s.langs.dictionary.take(pa.array(s.lang[at][order][first]))
                    yield pa.RecordBatch.from_arrays(
                        [lang, pa.array(h[first].astype(np.int32)), pa.array(g[first].view(np.int64)),
                         pa.array(np.diff(np.append(first, len(g)))), pa.array(np.minimum.reduceat(s.slot[at][order], first))],
                        ["lang", "shard", "gram", "n", "slot"])

    return run


_LOCAL = "lang string, shard int, gram long, n long, slot int"


def _words(s: _Step):
    for _, at, gram in s.grams(1):
        yield at, gram


def _pairs(known: Bitmap):
    def found(s: _Step):
        (_, at, one), (_, start, two) = s.grams(2)
        ok = known.has(s.shard, one)
        both = ok[start] & ok[start + 1]
        yield start[both], two[both]
    return found


def _longer(known: Bitmap):
    def found(s: _Step):
        ok = np.zeros(len(s.next), bool)
        for k, at, gram in s.grams(LONGEST):
            if k == 2:
                ok[at] = known.has(s.shard[at], gram)
            elif k > 2:
                keep = s.keep(at, k, ok)
                yield at[keep], gram[keep]
    return found


def _elsewhere(known: Bitmap):
    """Phrases of two words and more in the shards in which they are still to be counted."""
    def found(s: _Step):
        for k, at, gram in s.grams(LONGEST):
            if k > 1:
                hit = known.has(s.shard[at], gram)
                yield at[hit], gram[hit]
    return found


def _exact(known: Bitmap, slots: bool = False):
    """Rows (lang, phrase, size, n, gram) of marked phrases, as text; a task adds up its counts, HELD phrases at a time.

    ``slots``: phrases are marked with the slot of the texts that spell them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # hashes in order, where each one's count is, the counts, and (lang, phrase, size) of the same places
        held, place, count, told = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                s = _Step(part)
                low = s.w.raw.tobytes().lower()
                for k, at, gram in s.grams(LONGEST):
                    hit = known.has(s.slot[at] if slots else np.zeros(len(at), np.int32), gram)
                    g, first, n = np.unique(gram[hit], return_index=True, return_counts=True)
                    to = np.searchsorted(held, g)
                    new = np.ones(len(g), bool)
                    new[to < len(held)] = held[to[to < len(held)]] != g[to < len(held)]
                    count[place[to[~new]]] += n[~new]
                    at = at[hit][first[new]]
                    if not len(at):
                        continue
                    phrase = [b" ".join([low[a:b] for a, b in zip(x, y)]) for x, y in zip(
                        np.stack([s.w.start[at + i] for i in range(k)], 1).tolist(),
                        np.stack([s.w.end[at + i] for i in range(k)], 1).tolist())]
                    told.append((s.langs.dictionary.take(pa.array(s.lang[at])).cast(pa.string()),
                                 pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(np.full(len(at), k, np.int32)),
                                 pa.array(g[new].view(np.int64))))
                    held = np.insert(held, to[new], g[new])
                    place = np.insert(place, to[new], len(count) + np.arange(len(at)))
                    count = np.append(count, n[new])
                if len(held) > HELD:
                    yield from _told(told, count)
                    held, place, count, told = held[:0], place[:0], count[:0], []
        yield from _told(told, count)

    return run


def _told(told: list[tuple], count: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = 0
    for lang, phrase, size, gram in told:
        yield pa.RecordBatch.from_arrays([lang, phrase, size, pa.array(count[at:at + len(size)]), gram],
                                         ["lang", "phrase", "size", "n", "gram"])
        at += len(size)


def spelled(d: DataFrame, named: DataFrame) -> DataFrame:
    """(lang, phrase, size, n, gram) of the phrases ``named`` (slot, gram), from the texts ``d`` of their slots alone."""
    return d.mapInArrow(_exact(bitmap(named, "slot"), slots=True), "lang string, phrase string, size int, n long, gram long")


def frequent(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, text: str = "text", lang: str = "lang",
             shard: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all phrases of 1 to LONGEST words with at least ``support`` occurrences in their language
    (lang, phrase, size, f), and the words of each language (lang, total).

    ``shard`` deals rows to shards in a way that is the same in every pass (default: a hash of the text).
    """
    shard = F.xxhash64(text) if shard is None else shard
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"),
                    F.pmod(shard, F.lit(shards)).cast("int").alias("shard"),
                    F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(SLOTS)).cast("int").alias("slot"))

    def counts(found) -> DataFrame:
        return d.mapInArrow(_local(found), _LOCAL).groupBy("lang", "shard", "gram").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"))

    words = materialise(counts(_words), "shard-words")
    share = materialise(words.groupBy("lang", "shard").agg(F.sum("n").alias("_w")), "share")
    totals = share.groupBy("lang").agg(F.sum("_w").alias("total"))
    share = materialise(share.join(totals, "lang"), "share")

    least = F.expr(f"({support}L * _w + total - 1) div total")  # a whole number of occurrences reaches the share
    share = materialise(share.withColumn("_least", least), "share")

    def local(table: DataFrame) -> DataFrame:
        """Rows at the support that is the shard's share; (language, shard) has few values, and AQE measures them."""
        big = F.col("n").cast("decimal(38,0)") * F.col("total") >= F.col("_w").cast("decimal(38,0)") * support
        return table.join(share, ["lang", "shard"]).where(big).select("lang", "shard", "gram", "n", "_least", "slot")

    frequent_words = materialise(local(words), "frequent-words")
    known = bitmap(frequent_words)
    frequent_pairs = materialise(local(counts(_pairs(known))), "frequent-pairs")
    known = bitmap(frequent_pairs)
    frequent_longer = materialise(local(counts(_longer(known))), "frequent-longer")
    # All counts of words are known. Of a longer phrase a shard without it holds at most one less than its local
    # support, so a candidate that cannot reach the support even then is settled; all others are counted there.
    slack = share.groupBy("lang").agg(F.sum(F.col("_least") - 1).alias("_slack"))
    longer = (frequent_pairs.unionByName(frequent_longer).groupBy("lang", "gram")
              .agg(F.sum(F.col("n") - F.col("_least") + 1).alias("_over"), F.sum("n").alias("_in"),
                   F.collect_set("shard").alias("_shards"), F.min("slot").alias("slot")).join(slack, "lang")
              .where(F.col("_over") + F.col("_slack") >= support))
    longer = materialise(longer.select("lang", "gram", "_in", "_shards", "slot"), "candidates")
    open_ = longer.join(share.select("lang", "shard"), "lang").where("NOT array_contains(_shards, shard)").select("lang", "shard", "gram")
    open_ = materialise(open_, "open")
    more = counts(_elsewhere(bitmap(open_))).join(open_, ["lang", "shard", "gram"])
    more = more.groupBy("lang", "gram").agg(F.sum("n").alias("_more"))
    f = F.col("_in") + F.coalesce("_more", F.lit(0))
    longer = longer.join(more, ["lang", "gram"], "left").select("lang", "gram", "slot", f.alias("f"))
    single = words.groupBy("lang", "gram").agg(F.min("slot").alias("slot"), F.sum("n").alias("f"))
    f = materialise(longer.unionByName(single).where(F.col("f") >= support), "frequent-grams")
    names = spelled(d, f).groupBy("lang", "gram").agg(F.min(F.struct("phrase", "size")).alias("_p"))
    f = f.join(names, ["lang", "gram"]).select("lang", "_p.phrase", "_p.size", "f")
    return materialise(f, "frequent"), totals


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by the score of their weakest cut."""
    f, totals = frequent(docs, support, **how)
    parts = F.expr("""transform(sequence(1, size - 1), k -> named_struct('k', k,
        'l', array_join(slice(_p, 1, k), ' '), 'r', array_join(slice(_p, k + 1, size - k), ' ')))""")
    # no phrase that holds another is more frequent, so one word longer and as frequent drops a phrase
    cand = f.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("_p"))
    inner = cand.where("size > 2").select("lang", "a", F.explode(F.array(
        F.expr("array_join(slice(_p, 1, size - 1), ' ')"), F.expr("array_join(slice(_p, 2, size - 1), ' ')"))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    cand = cand.join(covered, ["lang", "phrase"], "left").where("_longer IS NULL OR 100 * _longer < 100 * a")
    cuts = cand.select("lang", "phrase", "a", F.inline(parts))
    one = f.select("lang", F.col("phrase").alias("l"), F.col("f").alias("_lf"))
    two = f.select("lang", F.col("phrase").alias("r"), F.col("f").alias("_rf"))
    cuts = cuts.join(one, ["lang", "l"]).join(two, ["lang", "r"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * total) div (CAST(_lf AS DECIMAL(38,0)) * _rf)")
    best = cuts.groupBy("lang", "phrase", "a", "total").agg(
        F.min(F.struct(score.alias("score"), "k", F.col("_lf").alias("l"), F.col("_rf").alias("r"))).alias("_cut"))
    rows = best.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"),
                       F.col("total").alias("n"), F.col("_cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # each slice of a language gives its own first rows, so one task orders at most SLICES times `top`
    rows = (rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("rank") <= top))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("text", "lang", F.col("_metadata.file_path").alias("_file"))
    return collocations(docs, shard=F.xxhash64("_file"))


ORACLE_SQL = {"op12_phrase_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM w),
s AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM g, range(1, 6) r(k) WHERE i + k - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM s WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM s GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
longer AS (
  SELECT lang, array_to_string(p[i:j], ' ') AS phrase, max(a) AS a
  FROM c, range(1, 6) x(i), range(1, 6) y(j) WHERE j > i AND j <= size AND j - i + 1 < size GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.a IS NULL OR 100 * o.a < 100 * c.a),
cuts AS (
  SELECT t.lang, t.phrase, t.a, q.k, l.f AS l, r.f AS r, n.n,
         (1000::HUGEINT * t.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM kept t, range(1, 5) q(k), f l, f r, n
  WHERE q.k < t.size AND n.lang = t.lang
    AND l.lang = t.lang AND l.phrase = array_to_string(t.p[1:q.k], ' ')
    AND r.lang = t.lang AND r.phrase = array_to_string(t.p[q.k + 1:t.size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""}
