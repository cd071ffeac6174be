"""Benchmark passages in documents: q-gram lemma filter and banded alignment.

Texts are compared in a plain form: lower case, every run of ASCII characters
other than letters and digits as one space. An item of m bytes may occur with
up to k = EDIT_PERCENT % of m edits. Such an occurrence shares at least
m + 1 - Q * (k + 1) of the item's q-grams, all within k + 1 neighbouring
diagonals (document position minus item position). So hits are counted in
bands of 2 (k + 1) diagonals that overlap by half; bands that reach the bound
are kept, and each is verified by an edit-distance alignment inside the band.
No occurrence within the budget is missed.

An item of 2 * LEAST_PART bytes or more is also looked for in parts: windows of
a third of it (LEAST_PART bytes at least) that begin at word starts and overlap
by half, each with an edit budget of its own, so a quoted half is found. A part
that overlaps an occurrence of the whole item is not reported.

Documents are read row by row and never shuffled. Benchmark items, a stated
query set, are taken in blocks of BLOCK_BYTES, whose index is shipped to the
tasks; a larger benchmark means more passes, not a larger index.

Defined results: items too short for one q-gram to survive an edit are
matched with fewer edits (down to none; below Q bytes as whole words); null,
empty or wordless items and texts match nothing; repeated documents or items
match each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.common import materialise, read

Q, EDIT_PERCENT = 10, 8
#: Bytes of the shortest part of an item that counts as its occurrence.
LEAST_PART = 100
BLOCK_BYTES = 4 << 20
#: Bits of the hash that the first, coarse lookup takes.
COARSE_BITS = 20
#: Most cells of the alignment matrices that are filled together.
ALIGN_CELLS = 1 << 20

_SPACE = np.ones(256, bool)
_SPACE[48:58] = _SPACE[97:123] = _SPACE[128:] = False


@dataclass
class Plain:
    """Texts in plain form: bytes, row offsets, and each byte's place in the lower-cased text."""

    raw: np.ndarray
    off: np.ndarray
    place: np.ndarray
    low_off: np.ndarray


def plain(texts: list[str]) -> Plain:
    low = [t.lower().encode("utf-8", "replace") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)
    raw = np.frombuffer(b"".join(low), np.uint8)
    space = _SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[off[:-1][off[:-1] < len(raw)]] = True
    done = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=done[1:])
    return Plain(np.where(space, 32, raw).astype(np.uint8)[keep], done[off], np.flatnonzero(keep), off)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that begins at each byte."""
    n = len(raw)
    if n < Q:
        return np.zeros(0, np.uint64)
    power, inverse = textvec._tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(textvec._BYTE[raw] * power[:n], out=total[1:])
    return textvec.mix((total[Q:] - total[:-Q]) * inverse[:n - Q + 1])


@dataclass
class Index:
    """Q-grams of a block of items."""

    ids: list
    text: list[bytes]
    budget: np.ndarray
    least: np.ndarray      # q-grams that an occurrence shares at least
    gram: np.ndarray       # sorted distinct hashes
    first: np.ndarray      # gram g is at first[g]:first[g + 1] of item, at
    item: np.ndarray
    at: np.ndarray
    coarse: np.ndarray
    short: list[int]
    owner: np.ndarray      # the item that an entry is, or is a part of
    whole: np.ndarray


def parts(item: bytes) -> list[bytes]:
    """Windows of an item, from word to word; none of a short item."""
    size = max(LEAST_PART, len(item) // 3)
    if len(item) < 2 * LEAST_PART:
        return []
    words = [0, *(i + 1 for i in range(len(item)) if item[i] == 32)]
    out = []
    for a in range(0, len(item), size // 2):
        begin = min((w for w in words if w >= a), default=len(item))
        end = item.find(b" ", begin + size)
        if len(item) - begin < size:  # the last one ends with the item
            begin = max((w for w in words if w <= len(item) - size), default=0)
            end = -1
        out.append(item[begin:] if end < 0 else item[begin:end])
        if end < 0:
            break
    return list(dict.fromkeys(x for x in out if x != item))


def index(items: list[tuple]) -> Index:
    form = plain([t or "" for _, t in items])
    whole_text = [form.raw[a:b].tobytes().strip(b" ") for a, b in zip(form.off, form.off[1:])]
    split = [(i, x) for i, t in enumerate(whole_text) for x in parts(t)]
    text = whole_text + [x for _, x in split]
    owner = np.array([*range(len(whole_text)), *(i for i, _ in split)], np.int64)
    m = np.array([len(x) for x in text], np.int64)
    budget = np.maximum(np.minimum(m * EDIT_PERCENT // 100, (m - Q) // Q), 0)
    grams, item, at = [], [], []
    for i, x in enumerate(text):
        g = _grams(np.frombuffer(x, np.uint8))
        grams.append(g)
        item.append(np.full(len(g), i))
        at.append(np.arange(len(g)))
    g = np.concatenate([np.zeros(0, np.uint64), *grams])
    order = np.argsort(g, kind="stable")
    gram, first = np.unique(g[order], return_index=True)
    coarse = np.zeros(1 << COARSE_BITS, bool)
    coarse[(gram >> np.uint64(64 - COARSE_BITS)).astype(np.int64)] = True
    whole = lambda x: np.concatenate([np.zeros(0, np.int64), *x])[order]
    return Index([items[i][0] for i in owner], text, budget, np.maximum(m + 1 - Q * (budget + 1), 1), gram,
                 np.append(first, len(g)), whole(item), whole(at), coarse,
                 [i for i, x in enumerate(text) if 0 < len(x) < Q], owner, np.arange(len(text)) < len(whole_text))


def _hits(raw: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document position, item and item position of every shared q-gram."""
    h = _grams(raw)
    where = np.flatnonzero(ix.coarse[(h >> np.uint64(64 - COARSE_BITS)).astype(np.int64)])
    g = np.searchsorted(ix.gram, h[where])
    g[g == len(ix.gram)] = 0
    same = ix.gram[g] == h[where] if len(ix.gram) else np.zeros(0, bool)
    where, g = where[same], g[same]
    n = ix.first[g + 1] - ix.first[g]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    entry = np.repeat(ix.first[g], n) + nth
    return np.repeat(where, n), ix.item[entry], ix.at[entry]


def _bands(p: Plain, ix: Index) -> np.ndarray:
    """(row, item, band, shared q-grams) of the bands that reach the bound."""
    at, item, inner = _hits(p.raw, ix)
    row = np.searchsorted(p.off, at, "right") - 1
    inside = at + Q <= p.off[row + 1]
    at, item, inner, row = at[inside], item[inside], inner[inside], row[inside]
    half = ix.budget[item] + 1
    band = (at - p.off[row] - inner) // half
    # a hit lies in two bands; equal hits of an item's q-gram count once
    key = np.concatenate([np.stack([row, item, b, inner]) for b in (band, band - 1)], axis=1).astype(np.int64)
    if not key.shape[1]:
        return np.zeros((0, 4), np.int64)
    key = key[:, np.lexsort(key[::-1])]
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    key = key[:3, new]
    start = np.ones(key.shape[1], bool)
    start[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    begin = np.flatnonzero(start)
    shared = np.diff(np.append(begin, key.shape[1]))
    out = np.concatenate([key[:, begin], shared[None]]).T
    return out[shared >= ix.least[out[:, 1]]]


def align(items: list[bytes], docs: list[np.ndarray], low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each item inside its document on diagonals low .. low + width - 1, and where it ends.

    Item i is aligned as a whole; the document part is free at both ends. All
    pairs are filled row by row together.
    """
    n, wide, rows = len(items), int(width.max()), max(map(len, items))
    reach = np.zeros((n, rows + wide + 2), np.uint8)
    for i, d in enumerate(docs):  # document bytes from its lowest diagonal on; 0 is outside
        part = d if isinstance(d, np.ndarray) else np.frombuffer(d, np.uint8)
        a, b = int(low[i]), int(low[i]) + rows + wide + 2
        cut = part[max(a, 0):max(b, 0)]
        reach[i, max(-a, 0):max(-a, 0) + len(cut)] = cut[:reach.shape[1] - max(-a, 0)]
    text = np.zeros((n, rows), np.uint8)
    size = np.array([len(x) for x in items])
    for i, x in enumerate(items):
        text[i, :len(x)] = np.frombuffer(x, np.uint8)
    diagonal = np.arange(wide, dtype=np.int32)
    big = np.int32(1 << 20)
    cost = np.where(diagonal < width[:, None], 0, big).astype(np.int32)
    final = cost.copy()
    closed = diagonal >= width[:, None]
    for r in range(rows):
        seen = reach[:, r:r + wide]
        step = cost + ((seen != text[:, r:r + 1]) | (seen == 0))
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step[closed] = big
        cost = np.minimum.accumulate(step - diagonal, axis=1) + diagonal
        cost[closed] = big
        done = size == r + 1
        final[done] = cost[done]
    best = final.argmin(axis=1)
    return final[np.arange(n), best], low + best + size


def _verify(p: Plain, ix: Index, bands: np.ndarray) -> list[tuple]:
    """(row, item, start, end, edits, shared) of the bands' occurrences, in bytes of the plain row."""
    out = []
    size = max([1, *(len(ix.text[i]) + 2 * int(ix.budget[i]) + 2 for i in set(bands[:, 1].tolist()))])
    group = max(1, ALIGN_CELLS // (size * 4))
    for a in range(0, len(bands), group):
        part = bands[a:a + group]
        items = [ix.text[i] for i in part[:, 1]]
        half = ix.budget[part[:, 1]] + 1
        low, width = part[:, 2] * half, 2 * half
        docs = [p.raw[p.off[r]:p.off[r + 1]] for r in part[:, 0]]  # views: the alignment copies what a band reaches
        edits, end = align(items, docs, low, width)
        ok = np.flatnonzero(edits <= ix.budget[part[:, 1]])
        if not len(ok):
            continue
        # the same from the end on gives the start
        back = [docs[i][::-1] for i in ok]
        m = np.array([len(items[i]) for i in ok])
        n = np.array([len(d) for d in back])
        _, rest = align([items[i][::-1] for i in ok], back, n - m - (low[ok] + width[ok] - 1), width[ok])
        for i, s in zip(ok.tolist(), (n - rest).tolist()):
            out.append((int(part[i, 0]), int(part[i, 1]), max(s, 0), int(min(end[i], len(docs[i]))), int(edits[i]), int(part[i, 3])))
    return out


def _short(p: Plain, ix: Index) -> list[tuple]:
    """Whole-word occurrences of items below one q-gram."""
    out = []
    for r in range(len(p.off) - 1) if ix.short else ():
        text = b" " + p.raw[p.off[r]:p.off[r + 1]].tobytes() + b" "
        for i in ix.short:
            at = text.find(b" " + ix.text[i] + b" ")
            while at >= 0:
                out.append((r, i, at, at + len(ix.text[i]), 0, 0))
                at = text.find(b" " + ix.text[i] + b" ", at + 1)
    return out


def _best(found: list[tuple]) -> list[tuple]:
    """Of overlapping occurrences of an item in a row, the one with fewest edits."""
    taken: dict[tuple, list[tuple]] = {}
    out = []
    for x in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2], x[3])):
        spans = taken.setdefault(x[:2], [])
        at = bisect_left(spans, (x[2], x[3]))
        if (at == 0 or spans[at - 1][1] <= x[2]) and (at == len(spans) or x[3] <= spans[at][0]):
            spans.insert(at, (x[2], x[3]))
            out.append(x)
    return out


def _span(text: str, p: Plain, row: int, start: int, end: int) -> tuple[int, int]:
    """Code points of the text that plain bytes start..end come from."""
    lengths = np.array([len(c.lower().encode("utf-8", "replace")) for c in text])
    to = np.cumsum(lengths)
    at = p.place[p.off[row] + np.array([start, max(end - 1, start)])] - p.low_off[row]
    a, b = np.searchsorted(to, at, "right")
    return int(a), int(b) + 1


SCHEMA = "item_id {item}, start long, end long, edits long, budget long, shared long, whole boolean"


def _apart(found: list[tuple], ix: Index) -> list[tuple]:
    """Occurrences of whole items, and those of parts that no whole one and no better part of the same item overlaps."""
    taken: dict[tuple, list[tuple]] = {}
    out = []
    for x in sorted(found, key=lambda x: (not ix.whole[x[1]], x[4], x[2], x[3])):
        spans = taken.setdefault((x[0], int(ix.owner[x[1]])), [])
        if ix.whole[x[1]] or not any(a < x[3] and x[2] < b for a, b in spans):
            spans.append(x[2:4])
            out.append(x)
    return sorted(out)


def _find(texts: list[str], ix: Index) -> tuple[Plain, list[tuple]]:
    p = plain(texts)
    return p, _apart(_best(_verify(p, ix, _bands(p, ix)) + _short(p, ix)), ix)


def _scan(docs: DataFrame, shipped, item_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                p, found = _find(texts, ix)
                rows = [(r, ix.ids[i], *_span(texts[r], p, r, s, e), edits, int(ix.budget[i]), shared, bool(ix.whole[i]))
                        for r, i, s, e, edits, shared in found]
                cols = list(zip(*rows)) or [()] * 8
                ids = part.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], names)
    names = ["doc_id", "item_id", "start", "end", "edits", "budget", "shared", "whole"]
    kinds = [pa.string() if item_type == "string" else pa.int64(), *[pa.int64()] * 5, pa.bool_()]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + SCHEMA.format(item=item_type))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits, budget, shared q-grams and whole (not a part) of each occurrence.

    One block of items is indexed and shipped at a time; what it finds is written before the next.
    """
    kind = dict(benchmark.dtypes)["item_id"]
    item_type = "string" if kind == "string" else "long"
    out = None
    for block in _blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(index(block))
        found = materialise(_scan(docs, shipped, item_type), "occurrences")
        shipped.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, " + SCHEMA.format(item=item_type))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no occurrence of an item."""
    for block in _blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(index(block))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textvec.steps(batch, "text"):
                    _, found = _find(pc.fill_null(part.column("text"), "").to_pylist(), shipped.value)
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in found]] = False
                    yield part.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark passage."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


ORACLE_SQL: dict[str, str] = {}
