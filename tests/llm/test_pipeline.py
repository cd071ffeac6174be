"""The pipeline against stages computed by brute force."""

import hashlib
import re

import numpy as np
import pytest
from .test_bpe import PATH, P
from .test_dedup import brute
from .test_quality import rejected

import corpus_pipeline
from lumen.llm import bpe, decontam


def test_run_equals_brute_force(spark, sf01, texts):
    import tiktoken
    kept = {k: t for k, t in texts.items() if not rejected(t)}
    groups = brute(kept, 5)
    kept = {k: t for k, t in kept.items() if groups[k][1] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()]
    order = sorted(kept)  # occurrences are compared with full edit-distance tables in test_decontam
    leaks = {order[x[0]] for x in decontam._find([kept[k] for k in order], decontam.index(items))[1]}
    kept = {k: t for k, t in kept.items() if k not in leaks}
    kept = {k: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t) for k, t in kept.items()}
    ranks = {p: i for i, p in enumerate(bpe.load_ranks(PATH))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for k, t in kept.items():
        ids = np.array(e.encode_ordinary(t), "<u4")
        want.add((k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf01).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, sf01, edge):
    from pyspark.sql import functions as F
    # a match of n bytes costs the last stage n^2 steps: long texts here have many words, not one
    edge = edge.where("length(replace(text, 'x', '')) > 0 or coalesce(length(text), 0) < 3000")
    docs = edge.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf01)
            assert out.dtypes == d.dtypes, name
            assert out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, sf01).count() == d.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "secret_scan", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and decontam.EDIT_PERCENT == 8


@pytest.mark.parametrize("word", ["llm", "corpus_pipeline"])
def test_other_modules_do_not_import_it(word):
    import pathlib
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in (root / "lumen").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(rf"import .*\b{word}\b|from lumen\.{word}", f.read_text())
