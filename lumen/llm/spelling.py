"""Spelling variants by a relational trie frontier.

The vocabulary is kept as two distributed tries, of the words and of the
reversed words. A trie is an edge table (node, first character, label, child):
nodes are 64-bit hashes of prefixes, chains without a branch are one edge, and
an edge knows the lengths of what may follow. States (word, position, node,
edits) are joined with the edge table level by level. A state without an edit
stands on the word's own path; a replacement or a deletion moves it to another
branch, after which the rest of the word must match exactly. A state that
reaches the end of a word after one edit makes the two words neighbours.

An edit in the second half of a word is looked for in the forward trie, one in
the first half in the reversed trie, so no state branches off near a root.
Insertions are deletions of the other word; of two words that differ by a
replacement the one with the smaller character looks for the other. The last
character of a run stands for a deletion anywhere in the run.

Hash collisions can only add candidates, which the edit distance of the pair
removes at the end. There are as many levels as a word has branching nodes
after the edit, however long the word.

Defined results: null and empty texts have no words; a null id counts as empty
before the colon; repeated rows count again; of equally frequent near words
the smallest in code-point order is the form; a text without gaps is one word,
whatever its length; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.common import materialise, read, shuffled

#: Fixed by the contract: one of so many (document, run) pairs loses a character.
DROP = 199
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: Remaining lengths below an edge are bits; longer ones share the last.
LENGTH_BITS = 62

#: Most bytes of states, as counted, that a level ships to the edges; more of them meet the edges over a shuffle.
SHIPPED_BYTES = 4 << 20

_U32 = np.uint32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=_U32)
    for _ in range(8):
        t = np.where(t & _U32(1), (t >> _U32(1)) ^ _U32(0xEDB88320), t >> _U32(1))
    return t


_CRC = _crc_table()
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc(raw: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after the bytes ``start:end`` of each run, all runs a byte at a time."""
    state = state.copy()
    order = np.argsort(start - end, kind="stable")  # longest first
    size = (end - start)[order]
    at, live, k = start[order], len(order), 0
    while live:
        live = int(np.searchsorted(-size, -k, "left"))  # runs of more than k bytes
        if not live:
            break
        if live <= 4:  # a few very long runs
            import zlib
            for j in range(live):
                i = order[j]
                done = zlib.crc32(raw[at[j] + k:end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF)
                state[i] = done ^ 0xFFFFFFFF
            break
        who = order[:live]
        s = state[who]
        state[who] = _CRC[(s ^ raw[at[:live] + k]) & _U32(0xFF)] ^ (s >> _U32(8))
        k += 1
    return state


def runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal letter runs (UTF-8 bytes): A-Z, a-z, U+00C0 to U+00FF."""
    n = len(raw)
    lead = raw == 0xC3  # first byte of U+00C0 to U+00FF, whose second byte is any continuation
    letter = _ASCII_LETTER[raw] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a row begins or ends here
    before = np.zeros(n, bool)
    before[1:] = letter[:-1] & ~edge[1:n]
    after = np.zeros(n, bool)
    after[:-1] = letter[1:] & ~edge[1:n]
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): occurrences in a step of the texts, after the dealt deletions."""
    for batch in batches:
        for part in textvec.steps(batch, "text"):
            raw, off = textvec.buffers(part.column("text"))
            raw = _LOWER[raw]
            start, end, row = runs(raw, off)
            keys = [("" if k is None else str(k)).encode() + b":" for k in part.column("doc_id").to_pylist()]
            key_raw = np.frombuffer(b"".join(keys), np.uint8)
            key_off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
            seed = _crc(key_raw, key_off[:-1], key_off[1:], np.full(len(keys), 0xFFFFFFFF, _U32))
            h = _crc(raw, start, end, seed[row]) ^ _U32(0xFFFFFFFF)
            drop = h % _U32(DROP) == 0
            text = raw.tobytes()
            out: dict[bytes, int] = {}
            for a, b, x in zip(start[drop].tolist(), end[drop].tolist(), h[drop].tolist()):
                run = text[a:b].decode()
                at = x % len(run)
                word = (run[:at] + run[at + 1:]).encode()
                out[word] = out.get(word, 0) + 1
            # the others: of at least as many bytes as characters are asked for, counted by 64-bit hash
            keep = ~drop & (end - start >= LEAST_LENGTH)
            start, end = start[keep], end[keep]
            _, first, n = np.unique(textvec.span_hash(raw, start, end), return_index=True, return_counts=True)
            for a, b, x in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
                out[text[a:b]] = out.get(text[a:b], 0) + x
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.binary()).cast(pa.string()), pa.array(out.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``least_length`` code points and ``least_count`` occurrences.

    Each step of a task hands on distinct words, which Spark combines again before the shuffle.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    c = d.mapInArrow(_counted, "word string, n long")
    return (c.where(F.length("word") >= max(least_length, LEAST_LENGTH)).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


#: Characters of words that one step of a task takes (a longer word is a step of its own).
STEP_CHARS = 1 << 18


def _word_steps(batches: Iterator[pa.RecordBatch]):
    """Words of a step with their code points, lengths and starts."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        group = np.cumsum(size) // STEP_CHARS
        edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)]
        for i, j in zip(edge, edge[1:]):
            if j > i:
                cp = np.frombuffer("".join(words[i:j]).encode("utf-32-le"), np.uint32)
                yield words[i:j], cp, size[i:j], np.cumsum(size[i:j]) - size[i:j]


def _nodes(cp: np.ndarray, size: np.ndarray, start: np.ndarray, which: np.ndarray, pos: np.ndarray, way: int) -> np.ndarray:
    """Hashes of the first ``pos`` characters of the words ``which``."""
    at = np.arange(len(cp)) - np.repeat(start, size)
    total = np.zeros(len(cp) + 1, np.uint64)
    power = textvec.powers(int(size.max(initial=0)) + 1)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[at], out=total[1:])
    h = total[start[which] + pos] - total[start[which]]
    return textvec.mix(h + pos.astype(np.uint64) + np.uint64((way + 1) << 40))


def _prefixes(least: int):
    """Rows (wid, way, pos, node, next, more) for the prefixes of ``least`` and more characters, both ways; next is -1 at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, cp, size, start in _word_steps(batches):
            wid = _nodes(cp, size, start, np.arange(len(size)), size, 0)
            rows = np.maximum(size - least + 1, 0)
            which = np.repeat(np.arange(len(size)), rows)
            pos = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows) + least
            back = np.repeat(start + size - 1, size) - (np.arange(len(cp)) - np.repeat(start, size))
            for way, c in ((0, cp), (1, cp[back])):
                inside = pos < size[which]
                after = np.where(inside, c[np.minimum(start[which] + pos, len(c) - 1)].astype(np.int32), -1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(wid[which].view(np.int64)), pa.array(np.full(len(which), way, np.int8)),
                    pa.array(pos.astype(np.int32)), pa.array(_nodes(c, size, start, which, pos, way).view(np.int64)),
                    pa.array(after.astype(np.int32)), pa.array((size[which] - pos).astype(np.int32))],
                    ["wid", "way", "pos", "node", "next", "more"])

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, word): the node at which a word ends in the forward trie is its id."""
    for words, cp, size, start in _word_steps(batches):
        wid = _nodes(cp, size, start, np.arange(len(size)), size, 0)
        yield pa.RecordBatch.from_arrays([pa.array(wid.view(np.int64)), pa.array(words, pa.string())], ["wid", "word"])


def tries(words: DataFrame, least_length: int = LEAST_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(edges, paths) of both tries of ``words`` (word, n).

    ``edges``: node, head, label, child, lens (bits of the lengths that may
    follow the child), end (id of the word that ends at the child, or null).
    ``paths``: wid, way, text (reversed for way 1), path (the word's own nodes in order).
    Nodes of fewer characters than half the shortest word are never reached and left out.
    """
    least = least_length // 2
    p = words.select("word").mapInArrow(_prefixes(least), "wid long, way byte, pos int, node long, next int, more int")
    nodes = (p.groupBy("node").agg(
        F.min("next").alias("lo"), F.max("next").alias("hi"),
        F.bit_or(F.expr(f"shiftleft(1L, least(more, {LENGTH_BITS}))")).alias("lens"),
        F.max(F.when(F.col("next") == -1, F.col("wid"))).alias("end"))
        .where("lo <> hi OR lo = -1").select("node", "lens", "end"))
    way = (p.select("wid", "way", "pos", "node").join(shuffled(nodes), "node")
           .groupBy("wid", "way").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "lens", "end"))).alias("path")))
    ids = words.select("word").mapInArrow(_ids, "wid long, word string")
    paths = materialise(way.join(shuffled(ids), "wid").select(
        "wid", "way", F.when(F.col("way") == 1, F.reverse("word")).otherwise(F.col("word")).alias("text"), "path"), "paths")
    steps = F.expr("transform(slice(path, 1, size(path) - 1), (x, i) -> named_struct('node', x.node, "
                   "'label', substring(text, x.pos + 1, path[i + 1].pos - x.pos), 'child', path[i + 1].node, "
                   "'lens', path[i + 1].lens, 'end', path[i + 1].end))")
    edges = (paths.where("size(path) > 1").select(F.inline(steps)).groupBy("node", "child")
             .agg(*[F.first(c).alias(c) for c in ("label", "lens", "end")])
             .select("node", F.substring("label", 1, 1).alias("head"), "label", "child", "lens", "end"))
    return materialise(edges, "edges"), paths


_FITS = f"(lens & shiftleft(1L, least(length(rest), {LENGTH_BITS}))) <> 0"


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(a, b): ids of all ordered pairs of words that differ by one edit, and candidates by hash collision."""
    edges, paths = tries(words, least_length)
    # the word's own nodes from its half on; `last` is null but at the node before its last character
    start = materialise(paths.select("wid", "way", "text", F.explode("path").alias("at"))
                        .where("at.pos >= IF(way = 1, length(text) - length(text) div 2, length(text) div 2) "
                               "AND at.pos < length(text)")
                        .select("wid", F.col("at.node").alias("node"), F.expr("substring(text, at.pos + 1)").alias("rest"),
                                F.when(F.expr("at.pos = length(text) - 1"), F.col("at.end")).alias("last")), "start")
    found = [start.where("last IS NOT NULL").select(F.col("wid").alias("a"), F.col("last").alias("b"))]
    s, e = start.select("wid", "node", F.col("rest").alias("was")), edges
    other = s.join(shuffled(e), "node").where("head <> substring(was, 1, 1)")
    edited = F.expr("""filter(array(
        IF(head > substring(was, 1, 1) AND startswith(substring(was, 2), substring(label, 2)),
           substring(was, length(label) + 1), NULL),
        IF(startswith(substring(was, 2), label), substring(was, length(label) + 2), NULL)), x -> x IS NOT NULL)""")
    states = materialise(other.select("wid", "child", "lens", "end", F.explode(edited).alias("rest"))
                         .where(_FITS).select("wid", F.col("child").alias("node"), "rest", "end"), "states")
    while True:
        found.append(states.where("rest = '' AND end IS NOT NULL").select(F.col("wid").alias("a"), F.col("end").alias("b")))
        live = states.where("rest <> ''").select("wid", "node", F.col("rest").alias("was"))
        n, size = live.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("was")), F.lit(0))).first()
        if not n:
            break
        live = live.withColumn("head", F.substring("was", 1, 1))
        live = F.broadcast(live) if n * 64 + 2 * size <= SHIPPED_BYTES else shuffled(live)
        states = materialise(
            live.join(e, ["node", "head"]).where("startswith(was, label)")
            .select("wid", "child", "lens", "end", F.expr("substring(was, length(label) + 1)").alias("rest"))
            .where(_FITS).select("wid", F.col("child").alias("node"), "rest", "end"), "states")
    one = reduce(DataFrame.unionByName, found)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def group_spellings(words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n; words distinct)."""
    ids = words.select("word").mapInArrow(_ids, "wid long, word string")
    known = materialise(ids.join(shuffled(words.select("word", "n")), "word"), "words")
    pairs = neighbours(words, least_length)
    a = known.select(F.col("wid").alias("a"), F.col("word").alias("_aw"))
    b = known.select(F.col("wid").alias("b"), F.col("word").alias("_bw"), F.col("n").alias("_bn"))
    near = (pairs.join(shuffled(b), "b").join(shuffled(a), "a").where(F.levenshtein("_aw", "_bw", 1) == 1)
            .groupBy(F.col("_aw").alias("word")).agg(
                F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_bn")).alias("n"), F.col("_bw").alias("w"))).alias("_best")))
    best = -F.col("_best.n")
    t = materialise(words.select("word", "n").join(shuffled(near), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(best >= ratio * F.col("n"), F.col("_best.w")).alias("form"),
        F.when(best >= ratio * F.col("n"), best).alias("form_n")), "forms")
    # a form is at least `ratio` times as frequent, so chains are short; each step doubles the way that is known
    root = materialise(t.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = materialise(root.alias("x").join(
            shuffled(root.select(F.col("word").alias("root"), F.col("root").alias("_next"))), "root", "left")
            .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        root = step.select("word", "root")
        if step.where("_moved").isEmpty():
            break
    return t.join(shuffled(root), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialise(vocabulary(read(spark, sf_dir, "documents")), "vocabulary")
    return group_spellings(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The same words by plain SQL: crc32 bit by bit, neighbours by the words with one character cut out.
ORACLE_SQL = {"op11_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
         ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x:
    list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))),
    4294967295) AS h FROM bytes),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
              ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT c.word AS a, v.word AS b FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
near AS (
  SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, v.n AS bn
  FROM pairs JOIN v ON v.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * v.n THEN b END AS form, CASE WHEN bn >= 5 * v.n THEN bn END AS form_n
  FROM v LEFT JOIN near ON near.a = v.word),
chain AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends ON ends.word = f.word
"""}
