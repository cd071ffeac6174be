"""Byte-level BPE by ranked merges in the tasks that read the texts.

A match's bytes start as one piece each; step by step the adjacent pair whose
joined bytes have the least rank is joined, leftmost first, until no pair has a
rank. Ranks are shipped to the tasks once. Long matches keep their pairs in a
heap, so n bytes take about n log n steps. Decoding looks pieces up by id and
concatenates them.

Frequent words (between spaces) and runs of marks are merged once for the
corpus: their number is bounded by FREQUENT, so their ids are shipped to the
tasks. A task replaces them as it reads a text; pieces outside the table are
merged there and then. No text is shuffled, only pieces with their counts are.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows are encoded each; an empty table gives an empty result; other
columns are not read. Ids outside the vocabulary raise an error in ``decode``.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.common import materialise, most_frequent, read, release

#: Most pieces whose ids are shipped to tasks.
FREQUENT = 1 << 19
#: Parts in which they pass through the driver, one at a time.
PARTS = 8
#: Characters of a plan's text that the driver keeps.
PLAN_TEXT = 1 << 16
#: Words with marks that a worker keeps put together.
TOGETHER = 1 << 18

#: Bytes of a match from which its pairs are kept in a heap.
LONG = 128

#: Unicode white space, as \s means it in the tokenizer's pattern.
_WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Before a key of the table: the piece stands alone, no space goes before it.
_BARE = "\x01"
#: ASCII marks; the pattern always cuts between a letter and one of them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_WORD_MARKS = r"""^(.*\p{L})([!"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~]+)$"""
_NONE = 1 << 62


def load_ranks(path: str) -> list[bytes]:
    """Pieces in rank order from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = sorted(rank, key=rank.__getitem__)
    if [rank[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return pieces


def spelled_pattern(pattern: str) -> str:
    """The pattern with white space spelled out (Python's \\s holds four control characters more)."""
    return pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


def merged(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    whole = rank.get(word)
    if whole is not None:
        return [whole]
    if len(word) >= LONG:
        return _merged_long(word, rank)
    get, cut = rank.get, list(range(len(word) + 1))
    pair = [get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == _NONE:
            break
        i = pair.index(least)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[cut[i]:cut[i + 2]], _NONE)
        if i:
            pair[i - 1] = get(word[cut[i - 1]:cut[i + 1]], _NONE)
    return [rank[word[x:y]] for x, y in zip(cut, cut[1:])]


def _merged_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """``merged`` with the pairs in a heap; a piece is known by its first byte, an entry holds while its rank is the pair's."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    pair = [rank.get(word[i:i + 2], _NONE) for i in range(n - 1)] + [_NONE]
    heap = [(r, i) for i, r in enumerate(pair) if r != _NONE]
    heapq.heapify(heap)

    def put(i: int) -> None:
        pair[i] = rank.get(word[i:end[end[i]]], _NONE) if end[i] < n else _NONE
        if pair[i] != _NONE:
            heapq.heappush(heap, (pair[i], i))
    while heap:
        r, i = heapq.heappop(heap)
        if pair[i] != r:
            continue
        gone = end[i]
        pair[gone], end[i] = _NONE, end[gone]
        if end[i] < n:
            before[end[i]] = i
        put(i)
        if before[i] >= 0:
            put(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[word[i:end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranked pieces, the pattern that cuts texts into matches, and column expressions over ids."""

    def __init__(self, path: str, pattern: str):
        self.pieces, self.pattern = load_ranks(path), spelled_pattern(pattern)
        self._pieces = F.split(F.lit(",".join(p.hex().upper() for p in self.pieces)), ",")
        self._ids = F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in range(len(self.pieces)))), ",")

    def decode(self, ids: Column) -> Column:
        """Bytes of a list of ids."""
        known = F.transform(F.array(self._pieces), lambda p: F.array_join(
            F.transform(ids, lambda i: F.coalesce(F.get(p, i), F.raise_error(F.lit("unknown id")).cast("string"))), ""))[0]
        return F.unhex(known)

    def id_bytes(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return F.unhex(F.transform(F.array(self._ids), lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), ""))[0])


def frequent_pieces(docs: DataFrame, merges: Merges, most: int = FREQUENT) -> DataFrame:
    """(piece, ids) of the most frequent words after a space and mark runs of the corpus, at most ``most``.

    What stands between spaces is counted over all documents; only the
    distinct pieces are then parted into word and marks.
    """
    counts = docs.select(F.explode(F.split("text", " ")).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.where(~F.col("piece").contains(_BARE))  # those texts are encoded whole
    lines = counts.select(F.posexplode(F.split("piece", "\n")).alias("line", "piece"), "c")
    marks = F.regexp_extract("piece", _WORD_MARKS, 2)
    word = F.concat(F.when(F.col("line") > 0, _BARE).otherwise(" "),
                    F.when(marks != "", F.regexp_extract("piece", _WORD_MARKS, 1)).otherwise(F.col("piece")))
    end = F.when(F.col("line") > 0, _BARE + "\n").otherwise("")
    key = F.array(word, F.when(marks != "", F.concat(F.lit(_BARE), marks)).otherwise(""), end)
    parts = materialise(lines.select(F.explode(key).alias("piece"), "c").where("length(piece) > 1 or piece = ' '")
                        .groupBy("piece").agg(F.sum("c").alias("c")), "pieces")
    top = most_frequent(parts, "c", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = merges.words([])
        for batch in batches:
            ids = [words[_key(piece)] for piece in batch.column("piece").to_pylist()]
            yield pa.record_batch([batch.column("piece"), _lists(ids)], ["piece", "ids"])
    return top.select("piece").mapInArrow(run, "piece string, ids array<int>")


#: A space inside white space or at its end; such a text is not cut into pieces.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
#: White space next to white space or to the text's ends: lines of such a text are not cut apart.
_WIDE_SPACE = re.compile(r"\s\s|\A\s|\s\Z")


def _key(piece: str) -> str:
    """A piece as tables hold it: what follows a space, or _BARE and what stands alone."""
    return piece[1:] if piece.startswith(" ") else piece


class _Words(dict):
    """Ids of what follows a space (or stands alone, after _BARE); words with marks are put together from both,
    what is not in the table is merged."""

    def __init__(self, known: dict[str, bytes], pieces: list[bytes], pattern: str):
        super().__init__(known)
        self.room = len(known) + TOGETHER
        self.rank = {p: r for r, p in enumerate(pieces)}
        self.matches = regex.compile(pattern).findall

    def merge(self, text: str) -> bytes:
        """Ids of a text of any number of matches."""
        ids = [i for m in self.matches(text) for i in merged(m.encode(), self.rank)]
        return np.array(ids, "<i4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        stem = piece.rstrip(_MARKS)
        if len(stem) == len(piece) or not stem[-1:].isalpha():
            return self.merge(piece[1:] if piece[:1] == _BARE else " " + piece)
        ids = self[stem] + self[_BARE + piece[len(stem):]]
        if stem in self and len(self) < self.room:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a whole text.

        A match of the pattern never reaches over a space that follows a
        non-space, so the ids of the pieces in sequence are the ids of the text. A
        line end between other characters is a match of its own.
        """
        if _INNER_SPACE.search(text) or _BARE in text:
            return self.merge(text)
        text = _BARE + text if _WIDE_SPACE.search(text) else _BARE + text.replace("\n", f" {_BARE}\n {_BARE}")
        return b"".join(map(self.__getitem__, text.split(" ")))


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Ids as a list column."""
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), "<i4")))


#: Table that this worker process built last, by its name.
_TABLES: dict[str, _Words] = {}


class Merges:
    """The vocabulary as tasks get it."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary):
        self.shipped = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.pattern))

    def words(self, parts: list, name: str = "") -> _Words:
        """Ids of known pieces, from broadcasts of them; a worker keeps those of one name."""
        if name and name in _TABLES:
            return _TABLES[name]
        known = {}
        for part in parts:
            for b in pa.ipc.open_stream(part.value):
                ids = b.column("ids")
                flat, off = ids.values.to_numpy().astype("<i4").tobytes(), ids.offsets.to_pylist()
                for piece, x, y in zip(b.column("piece").to_pylist(), off, off[1:]):
                    known[_key(piece)] = flat[4 * x:4 * y]
        words = _Words(known, *self.shipped.value)
        if name:
            _TABLES.clear()
            _TABLES[name] = words
        return words


def _ship(top: DataFrame, parts: int = PARTS) -> list:
    """Broadcasts of ``top`` (piece, ids), a bounded part of it at a time on the driver."""
    top, shipped = materialise(top, "frequent-pieces"), []
    for k in range(parts):
        part = top.where(F.pmod(F.xxhash64("piece"), F.lit(parts)) == k).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        shipped.append(top.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()))
        del part, sink
    pa.default_memory_pool().release_unused()
    release(top.sparkSession)
    return shipped


def _look_up(docs: DataFrame, top: DataFrame, merges: Merges) -> DataFrame:
    """doc_id and ids of every text, from the table of frequent pieces and merges of all others."""
    shipped, name = _ship(top), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = merges.words(shipped, name)
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                ids = [words.ids(t) for t in pc.fill_null(part.column("text"), "").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def encode(docs: DataFrame, vocabulary: Vocabulary, most: int = FREQUENT) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    spark = docs.sparkSession
    release(spark)
    # plans that decode hold the vocabulary as a literal, and the driver keeps their text for every stage that ends
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    merges = Merges(spark, vocabulary)
    return _look_up(docs, frequent_pieces(docs, merges, most), merges)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` plus ``decoded``, the bytes of its ids."""
    return encoded.withColumn("decoded", vocabulary.decode(F.col("ids")))


def _digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    v = Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return decode(encode(docs, v), v).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(v.id_bytes(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: token counts and digests of the ids and of the bytes they decode to."""
    return _digests(docs)


ORACLE_SQL: dict[str, str] = {}
