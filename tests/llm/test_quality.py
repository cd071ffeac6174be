"""Rule ledger against the rules written out, policies and ablations against plain recounts."""

import re
from collections import Counter, defaultdict

import pytest
from .texts import DOCS

from lumen.llm import quality as q
from tools.oracle_check import duck, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_upper": sum(c.isupper() and c.lower() != c for c in text), "n_bang": text.count("!"), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)})}


def rejected(text, policy=q.PRODUCTION):
    m = measures(text)
    return any(eval(r.failed, {}, m) for r in q.RULES if r.name in policy.rules)


def test_query_equals_rules(spark, sf01, texts):
    for r in q.op1_quality_ledger(spark, sf01).collect():
        m = measures(texts[r.doc_id])
        assert {k: r[k] for k in m} == m
        assert r.fail_bits == sum(1 << i for i, x in enumerate(q.RULES) if eval(x.failed, {}, m))
        assert r.base_failed == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])
        assert r.kept == (not rejected(texts[r.doc_id])) and not (r.kept and r.base_failed)


def test_oracle(spark, sf01):
    df, cur = q.op1_quality_ledger(spark, sf01), duck(sf01).execute(q.ORACLE_SQL["op1_quality_ledger"])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("text", ["a a a a", "a b c a b c", "x", "", "a\na\n \n \na ", "\n\n", "a b a b a b a", "é É ß", "a b c d a b c e a b c"])
def test_windows_and_lines(spark, text):
    got = q.measure(spark.createDataFrame([(1, text)], DOCS)).first().asDict()
    m = measures(text)
    assert {k: got[k] for k in m} == m


def test_edges(spark, edge):
    rows = q.ledger(edge).collect()
    assert len(rows) == edge.count()
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words) for r in rows) == sorted(
        (str(r.doc_id), measures(r.text)["n_words"], measures(r.text)["n_repeat_words"]) for r in edge.collect())
    assert q.ledger(spark.createDataFrame([], DOCS)).count() == 0
    assert q.stage(spark, edge, "").columns == edge.columns


def test_policies_and_ablations(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    led = q.apply_policies(q.ledger(docs)).cache()
    rows = led.collect()
    bit = {r.name: 1 << i for i, r in enumerate(q.RULES)}
    for a in q.ablate(led).collect():
        p = next(p for p in q.POLICIES if (p.name, p.version) == (a.policy, a.version))
        hit = Counter(r.fail_bits & p.mask for r in rows)
        b = bit[a.rule]
        assert a.n_failed == sum(n for h, n in hit.items() if h & b)
        assert a.n_only_this == hit[b] and a.n_kept == hit[0] == sum(r[f"keep_{p.name}_v{p.version}"] for r in rows)
        assert a.n_kept_without == sum(n for h, n in hit.items() if not h & ~b)
