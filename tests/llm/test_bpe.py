"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import pytest
from .texts import DOCS, EDGE_TEXTS
from .test_tokens import SPACES

from lumen.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {p: i for i, p in enumerate(bpe.load_ranks(PATH))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return e.encode_ordinary


def test_query_equals_library(spark, sf01, texts, library):
    got = {r.doc_id: r for r in bpe.op8_byte_bpe(spark, sf01).collect()}
    assert sorted(got) == sorted(texts)
    for k, t in texts.items():
        ids = np.array(library(t), "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_edges(spark, library, most):
    rng = np.random.default_rng(3)
    chars = list("ab1'.s \n\t") + [" ", "é", "🙂", "\x01", "\x1c", "\x85", "中", "​"]
    made = ["".join(rng.choice(chars, 30)) for _ in range(400)]
    edge = [t if t is None else t[:3000] for t in EDGE_TEXTS]
    lines = ["One. Two\nThree, four!!\nFive", "One.\n\nTwo", "\x01One. Two", "a \x01One\n"]
    rows = list(enumerate(edge + SPACES + made + lines * 3)) + [(None, "no id"), (3, "one"), (3, "one")]
    v = bpe.Vocabulary(PATH, P.PATTERN)
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS), v, most), v).collect()
    want = sorted((str(k), library(t or ""), (t or "").encode()) for k, t in rows)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == want


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], DOCS), bpe.Vocabulary(PATH, P.PATTERN)).count() == 0


def test_a_long_word_ends(spark, library):
    """Pairs of a long match are kept in a heap: 300,000 letters without a space end, with the library's ids."""
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdeginrst"), 300_000))
    got = bpe.encode(spark.createDataFrame([(1, long), (2, "a b")], DOCS), bpe.Vocabulary(PATH, P.PATTERN)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {1: library(long), 2: library("a b")}


def test_plans_that_encode_hold_no_vocabulary(spark):
    """The driver keeps plans, so ranks and joined pairs must reach the tasks otherwise."""
    encoded = bpe.encode(spark.createDataFrame([(1, "one two")], DOCS), bpe.Vocabulary(PATH, P.PATTERN))
    assert len(encoded._jdf.queryExecution().logical().toString()) < 5000


def test_both_ways_of_merging_agree():
    rank = {p: r for r, p in enumerate(bpe.load_ranks(PATH))}
    rng = np.random.default_rng(6)
    for n in [2, 3, 5, 9, 20, 60, bpe.LONG - 1] * 20:
        word = bytes(rng.choice(list(b"aabeinst\xc3\xa9"), n).tolist())
        if word not in rank:
            assert bpe.merged(word, rank) == bpe._merged_long(word, rank)
