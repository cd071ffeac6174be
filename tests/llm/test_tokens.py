"""Token files against the tokenizers library on whole texts."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from .texts import DOCS, EDGE_TEXTS
from pyspark.sql import functions as F

from lumen.llm import tokens

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_equals_library(spark, sf01, texts, library):
    got = {r.doc_id: r for r in tokens.op7_token_parquet(spark, sf01).collect()}
    assert sorted(got) == sorted(texts)
    at = 0
    for k in sorted(texts):
        ids = library(texts[k])
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


SPACES = ["a  b", "a \n b", "a\n b", "a\n\n  b", " a", "a ", "a  ", "  b", "a  b", "don't  stop 's", "x  y", "1 2  3 ", "<|endoftext|> x", "x<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext"]


def test_pieces_equal_whole_texts(spark, library):
    rng = np.random.default_rng(3)
    chars = list("ab1'.s \n\t") + [" ", "é", "🙂", "\x1c", "\x85", "​"]
    made = ["".join(rng.choice(chars, 30)) for _ in range(3000)]
    every = [t or "" for t in EDGE_TEXTS] + SPACES + made
    docs = spark.createDataFrame(list(enumerate(every)), DOCS)
    for r in tokens.encode(docs, VOCABULARY).collect():
        assert r.ids == library(every[r.doc_id]), repr(every[r.doc_id])


def test_store_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "STORE", 5)
    encoder = tokens.PieceEncoder(VOCABULARY)
    for t in SPACES[4:6] + ["the cat, sat! on.the mat", "", "the cat", "naïve Ünï 42x"]:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, off = encoder.encode(raw, np.array([0, len(raw)]), np.array([False]))
        assert ids.tolist() == library(t)[:-1] and off.tolist() == [0, len(ids)]


@pytest.mark.parametrize("layout", sorted(tokens.LAYOUTS))
def test_files(spark, scratch_dir, texts, library, layout):
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    tokens.write_ids(docs, f"{scratch_dir}/{layout}", VOCABULARY, layout, page_rows=50, page_bytes=4096)
    files = sorted(glob.glob(f"{scratch_dir}/{layout}/*.parquet"))
    order = [k for f in files for k in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert order == sorted(texts)
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    ids_column = meta.column(meta.num_columns - 1)
    assert ids_column.has_offset_index and meta.column(0).has_column_index
    assert any(("DELTA" if layout == "delta" else "DICTIONARY") in e for e in ids_column.encodings)
    some = tokens.read_ids(spark, f"{scratch_dir}/{layout}", 10, 19)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10), LessThanOrEqual(doc_id,19)]" in \
        some._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert {r.doc_id: r.ids for r in some.collect()} == {k: library(texts[k]) for k in range(10, 20)}
    lengths = tokens.read_lengths(spark, f"{scratch_dir}/{layout}")
    assert "ids" not in lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert lengths.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(len(library(t)) for t in texts.values())


def test_edges(spark, scratch_dir, edge, library):
    tokens.write_ids(edge, f"{scratch_dir}/edge", VOCABULARY)
    rows = tokens.checksums(tokens.with_place(tokens.read_ids(spark, f"{scratch_dir}/edge")))
    rows = tokens.starts(rows).orderBy("start").collect()
    assert [r.doc_id for r in rows][:2] == [None, 0] and len(rows) == edge.count()
    want = {(r.doc_id, crc(library(r.text))) for r in edge.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.ids_crc32) for r in rows} == want
    tokens.write_ids(spark.createDataFrame([], DOCS), f"{scratch_dir}/none", VOCABULARY)
    assert tokens.read_lengths(spark, f"{scratch_dir}/none").count() == 0


def test_starts_when_a_task_writes_several_files(spark, texts, library, tmp_path):
    rows = [(k, texts[k][:200]) for k in sorted(texts)[:60]]
    old = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        tokens.write_ids(spark.createDataFrame(rows, DOCS), str(tmp_path / "ids"), VOCABULARY)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", old)
    assert len(glob.glob(str(tmp_path / "ids" / "*.parquet"))) >= 20
    got, at = {r.doc_id: r.start for r in tokens.read_lengths(spark, str(tmp_path / "ids")).collect()}, 0
    for k, t in rows:
        assert got[k] == at
        at += len(library(t))
