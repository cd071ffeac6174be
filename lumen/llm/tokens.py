"""Token ids as Parquet list columns with selective reads.

File format: one row per document in ascending ``doc_id`` order with columns
``doc_id``, ``n_tokens`` and ``ids`` (list of int). Parquet gives what training
readers need: ids dictionary-encoded or delta-encoded, row groups of a set
size, and a page index (minimum and maximum of each page, and its place), so a
read of some documents touches only their pages, and a read of lengths never
touches the ids. Partitions are ranges of ``doc_id``, files carry their order
in their rows, and offsets come from the lengths in the files.

Texts are encoded by the ``tokenizers`` library. Pieces of a text between
spaces are encoded once per worker and looked up afterwards: the pre-tokenizer
always ends a token before a space that follows a non-space, so ids of pieces
in sequence are the ids of the text. Texts in which a space stands inside a
run of white space, or that hold a special token of the vocabulary, are
encoded whole, by the library's own call.

Defined results: null and empty texts have the end id alone; null ``doc_id``
come first; repeated ``doc_id`` stand next to each other in order of their
text's checksum and size; an empty table gives no documents; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumen.llm import textvec
from lumen.llm.common import materialise, read, shared_path

END_ID = 2
#: Distinct pieces that a worker process keeps; past it the store starts anew.
STORE = 3_000_000

#: Parquet settings by encoding; dictionary pages suit a bounded vocabulary, deltas suit ids without a small one.
LAYOUTS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000

#: A space inside white space or at its end, where pieces between spaces are not independent (RE2 syntax).
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE_SPACE_WHITE = f"{_WHITE} ({_WHITE}|\\z)"

#: Marks that end a word; the pattern always cuts between a letter or digit and one of them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: White space next to white space or to the piece's ends.
_WIDE_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
#: The vocabulary's spelling of a space; ASCII letters and digits are spelled as themselves.
_SPACE = chr(288)
#: Parts of pieces (lines, runs of marks) whose ids a worker keeps.
PARTS_KEPT = 1 << 18


def byte_spelling() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the rest from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of texts from the ids of their pieces.

    Pieces are known by a 64-bit hash; the store is a pair of sorted runs (a
    large and a recent one) that point into one array of ids. Only distinct
    new pieces of a step go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spelling, self.parts = byte_spelling(), {}
        self._reset()

    def _reset(self) -> None:
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _part(self, text: str, encode: Callable[[str], list[int]]) -> list[int]:
        """Ids of a part of a piece; parts repeat more often than pieces, so the worker keeps them."""
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= PARTS_KEPT:
                self.parts.clear()
            ids = self.parts[text] = encode(text)
        return ids

    def _after_space(self, piece: str, space: str = " ") -> list[int]:
        stem = piece.rstrip(_MARKS)
        if stem.isalpha() or stem.isascii() and stem.isdigit():
            # " stem" is one match of the pattern: the library's merges alone
            spelled = (_SPACE if space else "") + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.spelling))
            ids = [t.id for t in self.library.model.tokenize(spelled)]
            return ids + self._part(piece[len(stem):], self._whole) if len(stem) < len(piece) else ids
        if "\n" in piece and not _WIDE_SPACE.search(piece):  # a line end between other characters is a match of its own
            first, *lines = piece.split("\n")
            ids = self._part(space + first, lambda x: self._after_space(first, space))
            for line in lines:
                ids = ids + self._part("\n", self._whole) + self._part(line, lambda x: self._after_space(x, ""))
            return ids
        return self._whole(space + piece)

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        total = int(n.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        start = self.used + np.cumsum(n) - n
        self.used += total
        self.runs[1] = _merged(self.runs[1], (keys, start, n))
        if len(self.runs[1][0]) * 4 > len(self.runs[0][0]):
            self.runs = [_merged(*self.runs), self.runs[1]]
            self.runs[1] = tuple(x[:0] for x in self.runs[1])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is known, and where its ids are."""
        known, start, n = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for key, at, size in self.runs:
            if len(key):
                i = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                hit = key[i] == keys
                known |= hit
                start[hit], n[hit] = at[i[hit]], size[i[hit]]
        return known, start, n

    def encode(self, raw: np.ndarray, off: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a step in sequence, and row offsets; ``whole``: rows that are one piece."""
        if len(self.runs[0][0]) + len(self.runs[1][0]) > STORE:
            self._reset()
        space = np.flatnonzero(raw == 0x20)
        if whole.any():
            space = space[~whole[np.searchsorted(off, space, "right") - 1]]
        begin = np.sort(np.concatenate([off[:-1], space + 1]))
        end = np.sort(np.concatenate([space, off[1:]]))
        count = np.searchsorted(space, off[1:]) - np.searchsorted(space, off[:-1]) + 1
        head = np.zeros(len(begin), bool)
        first = np.cumsum(count) - count
        head[first] = True
        key = _piece_keys(raw, begin, end, head)
        which, key = pd.factorize(key)  # by hashing; only the distinct keys are sorted
        order = np.argsort(key)
        key, rank = key[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, one = rank[which], np.empty(len(order), np.int64)
        one[which] = np.arange(len(which))
        known, _, _ = self._find(key)
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(begin[one[new]].tolist(), end[one[new]].tolist())]
            self._add(key[new], [self._whole(t) if h else self._after_space(t) for t, h in zip(texts, head[one[new]].tolist())])
        _, start, n = self._find(key)
        size = n[which]
        done = np.cumsum(size)
        at = np.arange(done[-1] if len(done) else 0) + np.repeat(start[which] - (done - size), size)
        return self.ids[at], np.concatenate([[0], done[first + count - 1]]) if len(first) else np.zeros(1, np.int64)


def _merged(a: tuple, b: tuple) -> tuple:
    key = np.concatenate([a[0], b[0]])
    order = np.argsort(key, kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


_LETTER = textvec.stream(6, 256)


def _piece_keys(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray:
    power, inverse = textvec._tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * power[:len(raw)], out=total[1:])
    return textvec.mix((total[end] - total[begin]) * inverse[begin] + ((end - begin) * 2 + head).astype(np.uint64))


#: Encoders of this worker process, by vocabulary file; tasks that follow use what earlier ones encoded.
_ENCODERS: dict[str, PieceEncoder] = {}


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and ids of every text, the end id appended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                raw, off = textvec.buffers(part.column("text"))
                text = pc.fill_null(part.column("text"), "")
                whole = pc.match_substring_regex(text, _WHITE_SPACE_WHITE)
                for token in encoder.special:
                    whole = pc.or_(whole, pc.match_substring(text, token))
                whole = whole.to_numpy(zero_copy_only=False)
                ids, at = encoder.encode(raw, off, whole)
                at = at + np.arange(len(at))  # each row ends with the end id
                flat = np.full(at[-1], end_id, np.int32)
                own = np.ones(len(flat), bool)
                own[at[1:] - 1] = False
                flat[own] = ids
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(at)), lists], ["doc_id", "n_tokens", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write_ids(docs: DataFrame, out: str, path: str, layout: str = "dictionary", end_id: int = END_ID,
              row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode ``docs`` and write them in ``doc_id`` order.

    Texts are sorted before they are encoded, so ids go from the encoder to
    the file. Equal keys are parted by read order: no key fills one task.
    """
    key = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit(""))), F.octet_length("text"),
           F.col("_read")]
    d = docs.select("doc_id", "text").withColumn("_read", F.monotonically_increasing_id())
    d = d.repartitionByRange(*key).sortWithinPartitions(*key)
    w = encode(d, path, end_id).write.option("parquet.block.size", str(row_group_bytes)) \
        .option("parquet.page.size", str(page_bytes)).option("parquet.page.row.count.limit", str(page_rows))
    for k, v in LAYOUTS[layout].items():
        w = w.option(k, v)
    w.parquet(out)


def read_ids(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents low <= doc_id <= high; the page index limits the read to their pages."""
    d = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    if low is not None:
        d = d.where(F.col("doc_id") >= low)
    return d if high is None else d.where(F.col("doc_id") <= high)


def with_place(ids: DataFrame) -> DataFrame:
    """Adds a number that orders the files, and a row's place in its file.

    A task may write several files: they count on within the task's number.
    """
    name = F.col("_metadata.file_name")
    task, file = F.regexp_extract(name, r"part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)\.", 1)
    return ids.withColumn("_file", F.shiftleft(task, 32) + F.coalesce(F.when(file != "", file).cast("long"), F.lit(0))).withColumn("_at", F.col("_metadata.row_index"))


def starts(d: DataFrame) -> DataFrame:
    """``start`` (ids of all documents before) in place of the place columns.

    The window over all files has one row per file; the one over documents is
    split by file.
    """
    files = d.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(files), "_file")
    return d.withColumn("start", F.col("_before") + F.col("_in")).drop("_file", "_at", "_before", "_in")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start of every document; the ids are not read."""
    return starts(with_place(read_ids(spark, path)).select("doc_id", "n_tokens", "_file", "_at"))


def checksums(ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            flat, off = col.flatten().to_numpy(zero_copy_only=False).astype("<u4"), col.offsets.to_numpy() - col.offsets[0].as_py()
            crc = pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])], pa.int64())
            yield pa.record_batch([*(batch.column(c) for c in keep), crc], [*keep, "ids_crc32"])
    keep = [c for c in ids.columns if c != "ids"]
    schema = ", ".join(f"{c} {t}" for c, t in ids.dtypes if c != "ids") + ", ids_crc32 long"
    return ids.mapInArrow(run, schema)


def op7_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = shared_path(spark, "token-ids")
    write_ids(read(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    # checksums are narrow rows; they are written before the two passes that place them
    sums = materialise(checksums(with_place(read_ids(spark, out))), "id-sums")
    return starts(sums).select("doc_id", "start", "n_tokens", "ids_crc32")


ORACLE_SQL: dict[str, str] = {}
