"""Base spans against the plain patterns; the dynamic programme against all labellings."""

import hashlib
import math
import random
import re

import pytest
from .texts import DOCS, EDGE_TEXTS

from lumen.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def made(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "b.c", "@", "x@y.z", "1", "25", "256", ".", "1.2.3.4", "0001.2.3.4", "+", "+1", "(", ")", "-", " ", "  ",
             "4111111111111111", "4111 1111-1111 1111", "555-5010", "%", "_", "é", "+1 (389) 555-5010", "\n", "٣"]
    return ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(n)]


def test_base_spans_equal_plain_patterns():
    for t in made(20000) + [x or "" for x in EDGE_TEXTS]:
        assert pii.base_spans(t) == plain(t), repr(t)


def test_long_texts_take_linear_time():
    for t in ("9" * 100_000, "a" * 100_000 + "@", "1.2." * 30_000, "@" * 100_000, "a@" * 50_000, "+1 " * 30_000, "9 " * 20_000):
        pii.find(t, {("card", "bias"): -1.0})


@pytest.fixture(scope="module")
def weights(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    return pii.learn(pii.sample(docs))


def test_query(spark, sf01, texts):
    rows = pii.op4_semi_markov_pii(spark, sf01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1]), int(x[2])))


@pytest.mark.parametrize("text, kind, span", [
    ("please call (389) 555-5010 today", "phone", "(389) 555-5010"),
    ("please call 389-555-5010 today", "phone", "389-555-5010"),
    ("write to jo.doe [at] mail6 [dot] example [dot] com soon", "email", "jo.doe [at] mail6 [dot] example [dot] com"),
    ("write to jo.doe(at)mail6.example.com soon", "email", "jo.doe(at)mail6.example.com"),
])
def test_other_notations_are_added(weights, text, kind, span):
    base, spans = pii.find(text, weights)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, span)]


@pytest.mark.parametrize("text", ["in 2024 there were 12,500 of 3.5 kinds", "version 1.2.3 of page 17", "4111111111111112 is no card",
                                  "at 10:45 on 12-05", "token 04dbebab91ab85687d33 of it", "no numbers at all"])
def test_clean_texts_stay_clean(weights, text):
    assert pii.find(text, weights) == ([], [])


def labellings(edge, segments, at, w):
    """(score, last label, entities) of all labellings of the atoms before ``at``."""
    if at == 0:
        yield 0.0, 0, ()
        return
    t = pii._transitions(w)
    for s, a, x in labellings(edge, segments, at - 1, w):
        yield s + t[a][0], 0, x
    for i, kind, f in segments.get(at, ()):
        k = 1 + pii.KINDS.index(kind)
        own = sum(w.get((kind, y), 0.0) for y in f)
        for s, a, x in labellings(edge, segments, i, w):
            yield s + t[a][k] + own, k, (*x, (kind, edge[i], edge[at]))


def random_weights(segments, r):
    w = {(k, f): r.uniform(-1, 1) for cells in segments.values() for _, k, fs in cells for f in fs}
    return w | {("then", a, b): r.uniform(-1, 1) for a in range(5) for b in range(5) if a or b}


def islands_with_segments(n, seed):
    for t in made(n, seed):
        edge, segments = pii.candidates(t[:24])
        if segments and len(edge) <= 13:
            yield t[:24], edge, segments


def test_programme_finds_the_best_labelling():
    """Viterbi, and the probabilities of its entities, against all labellings."""
    r, seen = random.Random(4), 0
    for t, edge, segments in islands_with_segments(400, 7):
        w = random_weights(segments, r)
        every = list(labellings(edge, segments, len(edge) - 1, w))
        got = pii.best(t, w)
        top = max(s for s, _, _ in every)
        assert max(s for s, _, x in every if x == tuple(e[:3] for e in got)) == pytest.approx(top)
        z = sum(math.exp(s) for s, _, _ in every)
        for e in got:
            assert e[3] == pytest.approx(sum(math.exp(s) for s, _, x in every if e[:3] in x) / z)
            seen += 1
    assert seen > 50


def test_likelihood_and_gradient():
    """The log probability against all labellings; its gradient against finite differences."""
    r, seen = random.Random(5), 0
    for t, edge, segments in islands_with_segments(300, 9):
        w = random_weights(segments, r)
        every = list(labellings(edge, segments, len(edge) - 1, w))
        truth = frozenset(max(every, key=lambda x: (len(x[2]), r.random()))[2])
        z = math.log(sum(math.exp(s) for s, _, _ in every))
        own = math.log(sum(math.exp(s) for s, _, x in every if frozenset(x) == truth))
        value, slope = pii.likelihood(edge, segments, truth, w)
        assert value == pytest.approx(own - z)
        for key in r.sample(sorted(slope, key=str), min(6, len(slope))):
            up, down = ({**w, key: w.get(key, 0.0) + h} for h in (1e-5, -1e-5))
            rise = pii.likelihood(edge, segments, truth, up)[0] - pii.likelihood(edge, segments, truth, down)[0]
            assert slope[key] == pytest.approx(rise / 2e-5, abs=1e-6)
            seen += 1
    assert seen > 200


def test_learning_raises_the_likelihood(spark, sf01, weights):
    texts_ = pii.sample(spark.read.parquet(f"{sf01}/documents.parquet"))
    total = [0.0, 0.0]
    for text in texts_[:20]:
        for part, truth in pii.examples(text):
            edge, segments = pii.candidates(part)
            if segments and truth <= {(k, edge[i], edge[j]) for j, c in segments.items() for i, k, _ in c}:
                for n, w in enumerate(({}, weights)):
                    total[n] += pii.likelihood(edge, segments, truth, w)[0]
    assert total[1] > 0.2 * total[0]  # both below zero


def recall(texts_, weights_, names):
    """Shares of spans found in notations, and found exactly."""
    found = n = 0
    for text in texts_:
        for kind, a, b in pii.base_spans(text):
            for name in names:
                if name[0] == kind:
                    v = pii.NOTATIONS[name](text[a:b])
                    shown = f"please note {v} for later"
                    _, spans = pii.find(shown, weights_)
                    n += 1
                    found += (kind, 12, 12 + len(v)) in spans
    return found / max(n, 1), n


@pytest.mark.parametrize("name", [("phone", "dashed"), ("email", "bracketed"), ("email", "round")])
def test_notations_kept_out_of_training(spark, sf01, name):
    """Notations that training need not show (README has the figures of all); half of the texts train, the others are asked."""
    every = pii.sample(spark.read.parquet(f"{sf01}/documents.parquet"))
    texts_, train = every[::2], every[1::2]
    share, n = recall(texts_, pii.learn(train, without=frozenset([name])), [name])
    assert n > 5 and share >= 0.5, (share, n)


def test_learned_notations(spark, sf01):
    every = pii.sample(spark.read.parquet(f"{sf01}/documents.parquet"))
    share, n = recall(every, pii.learn(every), list(pii.NOTATIONS))
    assert n > 60 and share > 0.95


def test_long_islands_train_on_windows():
    number = "+1 (389) 555-5010"
    text = " ".join(f"item{i} 12{i}" for i in range(200)) + f" call {number} now " + " ".join(f"9{i} x{i}" for i in range(200))
    got = pii.examples(text)
    assert any((k, number) in {(kind, t[a:b]) for kind, a, b in truth} for t, truth in got for k in ("phone",))
    assert all(len(t) <= max(pii.LONG, 2 * pii.AROUND + 40) for t, _ in got)


def test_edges(spark, edge, weights):
    rows = pii.personal_data(edge, weights).collect()
    assert len(rows) == edge.count() and all(r.spans == [] for r in rows)
    assert pii.sample(edge) == [] and pii.learn([]) == {}
    docs = spark.createDataFrame([], DOCS)
    assert pii.personal_data(docs, {}).count() == 0 and pii.sample(docs) == []
    same = spark.createDataFrame([(1, "x a@b.cd y"), (1, "x a@b.cd y")], DOCS)
    assert [[tuple(s) for s in r.spans] for r in pii.personal_data(same, {}).collect()] == [[("email", 2, 8)]] * 2


def test_addresses_with_many_zeros():
    """A part of thousands of zeros is small; one with four digits after them is not."""
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.2.3") == [("ip", 0, 5006)]
    assert pii.base_spans(f"{zeros}255.{zeros}.2.3")[0][0] == "ip"
    assert [s for s in pii.base_spans(f"{zeros}256.1.2.3") if s[0] == "ip"] == []
    assert [s for s in pii.base_spans(f"{'9' * 5000}.1.2.3") if s[0] == "ip"] == []
