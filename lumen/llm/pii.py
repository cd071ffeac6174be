"""Personal data by a semi-Markov conditional random field over whole spans.

Fixed rules give the base spans (email, ip, card, phone). The field adds
spans that the rules' formats miss: numbers and addresses written another way.
A text is cut into atoms (letter runs, digit runs, single other characters);
only stretches around digits, at-signs and their spelled forms can hold an
entity, and between them the best labelling is "nothing" with score 0, so the
search over such islands is the search over the text.

A labelling of an island is a sequence of segments: single atoms with the label
"nothing", and entities of at most MAX_ATOMS atoms. Its score is the sum of
the weights of its segments' whole-span features (shape, length, digit groups,
check sum, octets, words before) and of its label transitions. The probability
of a labelling is its exponential over the sum for all labellings, which
forward sums over segments give. A dynamic programme over (atom, label) finds
the best labelling, boundaries and types together; its entities are added
where their own probability, by forward and backward sums, reaches SURE.

Weights are learned here by maximum likelihood: the gradient of an island is
its observed less its expected features and transitions, in steps of AdaGrad
with an L2 term (every other pass without the features of an exact notation), over
islands of a bounded sample of documents that hold base
spans (SAMPLE documents, least hash of the text first), with variants of them
in other notations. An island over LONG characters trains on windows around
its spans.

Defined results: a null text is empty (no spans); texts of any length are read
whole, island by island; of equally good labellings the one with fewer
entities, then the one with the earlier start wins; repeated rows give equal
rows; without any base span in the corpus there is nothing to learn from and
nothing is added; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textvec
from lumen.llm.common import read

KINDS = ("email", "ip", "card", "phone")
#: Labelled documents that the field learns from, at most.
SAMPLE = 1500
EPOCHS = 8
MAX_ATOMS = 32
#: Probability from which on an entity of the best labelling is added.
SURE = 0.8
#: Learning steps (AdaGrad) and the weight of the L2 term in one.
RATE, L2 = 0.3, 1e-3
#: Features that every other pass leaves out, so that the others carry notations that training never shows.
_EXACT = ("marks:", "sizes:", "word:")
#: Characters of an island that trains as a whole, and around a span of a longer one.
LONG, AROUND = 400, 120

# fixed values: the formats of the base rules
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
        at = text.find("@", max(low, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed rules, kinds in order, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]  # a part may have any number of leading zeros
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# islands and segments

#: What a token that may be part of an entity holds.
_ANCHOR = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_REST = re.compile(r"\S*")
_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_SPELLED = re.compile(r"\s?[\[(](at|dot)[\])]\s?", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")
_GROUPS = re.compile(r"[0-9]+")


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of anchor tokens with the token before and after, merged where they meet."""
    out: list[tuple[int, int]] = []
    end, m = 0, _ANCHOR.search(text)
    while m:
        a, b = m.start(), _REST.match(text, m.start()).end()
        while a > end and not text[a - 1].isspace():
            a -= 1
        end = b
        left = text.rfind(" ", max(0, a - 40), max(a - 1, 0)) + 1
        a = max(left, a - 40) if left else a
        right = text.find(" ", b + 1, b + 41)
        b = right if right >= 0 else b
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
        m = _ANCHOR.search(text, end)
    return out


def features(seg: str, before: str) -> dict[str, list[str]]:
    """Kinds that the segment's characters allow, with its whole-span features."""
    out = {}
    spelled = _SPELLED.sub(lambda m: "@" if m.group(1).lower() == "at" else ".", seg)
    if _ADDRESS.fullmatch(spelled):
        host = spelled.rsplit("@", 1)[1].split(".")
        out["email"] = ["bias", f"plain{spelled == seg}", f"hosts{min(len(host), 4)}", f"top{min(len(host[-1]), 5)}",
                        f"top_alpha{host[-1].isalpha()}", f"local{min(len(spelled.split('@')[0]) // 4, 4)}", f"word:{before}"]
    if _NUMBER.fullmatch(seg):
        groups = _GROUPS.findall(seg)
        digits = "".join(groups)
        n, marks = len(digits), "".join(sorted(set(seg) - set("0123456789")))
        sizes = "-".join(map(str, map(len, groups[:6])))
        common = ["bias", f"n{min(n, 20)}", f"groups{min(len(groups), 6)}", f"word:{before}", f"marks:{marks}", f"sizes:{sizes}"]
        octets = len(groups) == 4 and all(len(g) <= 3 and int(g) < 256 for g in groups)
        if len(groups) == 4 and marks in (".", " ", "-", ""):
            out["ip"] = [*common, f"octets{octets}"]
        if 12 <= n <= 19 and "+" not in seg and "(" not in seg:
            out["card"] = [*common, f"luhn{luhn(digits)}", f"luhn{luhn(digits)}n{n}"]
        if 7 <= n <= 15:
            out["phone"] = [*common, f"plus{seg[0] == '+'}", f"bracket{'(' in seg}", f"luhn{n > 12 and luhn(digits)}",
                            f"octets{octets}", f"plain{not marks}"]
    return out


def candidates(text: str) -> tuple[list[int], dict[int, list[tuple[int, str, list[str]]]]]:
    """Atom boundaries of an island and, by end atom, its segments (start atom, kind, features)."""
    edge = [m.start() for m in _ATOM.finditer(text)] + [len(text)]
    out: dict[int, list[tuple[int, str, list[str]]]] = {}
    for i in range(len(edge) - 1):
        head = text[edge[i]]
        if head.isspace() or not (head.isalnum() or head in "+(._%-"):
            continue
        if i and (text[edge[i] - 1].isalnum() or text[edge[i] - 1] in "@+"):
            continue  # an entity begins at a word's edge
        words = re.findall(r"[^\W\d_]+", text[max(0, edge[i] - 20):edge[i]])
        before = words[-1].lower() if words else ""
        for j in range(i + 1, min(len(edge) - 1, i + MAX_ATOMS) + 1):
            tail = text[edge[j] - 1]
            if not tail.isalnum() or (edge[j] < len(text) and (text[edge[j]].isalnum() or text[edge[j]] == "@")):
                continue
            for kind, f in features(text[edge[i]:edge[j]], before).items():
                out.setdefault(j, []).append((i, kind, f))
    return edge, out


NOTHING, LABELS = 0, 1 + len(KINDS)
_LABEL = {k: i + 1 for i, k in enumerate(KINDS)}
_NEVER = float("-inf")

#: Weights of (kind, feature) and of transitions ("then", label before, label).
Weights = dict[tuple, float]


def _sum(x: list[float]) -> float:
    """Logarithm of the sum of exponentials."""
    top = max(x, default=_NEVER)
    return top if top == _NEVER else top + math.log(sum(math.exp(y - top) for y in x))


def _transitions(w: Weights) -> list[list[float]]:
    """Score of a label (second) after another (first); nothing after nothing scores 0."""
    return [[w.get(("then", a, b), 0.0) if a or b else 0.0 for b in range(LABELS)] for a in range(LABELS)]


def _scored(segments: dict, w: Weights) -> dict[int, list[tuple[int, int, float, str, list[str]]]]:
    """By end atom: (start atom, label, score, kind, features)."""
    return {j: [(i, _LABEL[k], sum(w.get((k, x), 0.0) for x in f), k, f) for i, k, f in cells] for j, cells in segments.items()}


def _forward(n: int, scored: dict, t: list[list[float]]) -> tuple[list[list[float]], list[list[float]]]:
    """Log sums over the labellings before each atom, by last label; and the same plus the transition to a label."""
    alpha, into = [[0.0] + [_NEVER] * (LABELS - 1)], []
    for j in range(n + 1):
        if j:
            own: list[list[float]] = [[] for _ in range(LABELS)]
            for i, k, s, _, _ in scored.get(j, ()):
                own[k].append(into[i][k] + s)
            alpha.append([into[j - 1][NOTHING], *map(_sum, own[1:])])
        some = [a for a in range(LABELS) if alpha[j][a] > _NEVER]
        into.append([alpha[j][0] + t[0][b] if some == [0] else _sum([alpha[j][a] + t[a][b] for a in some]) for b in range(LABELS)])
    return alpha, into


def _backward(n: int, scored: dict, t: list[list[float]]) -> list[list[float]]:
    """Log sums over the labellings from each atom on, by the label before."""
    ahead: dict[int, list[tuple[int, int, float]]] = {}
    for j, cells in scored.items():
        for i, k, s, _, _ in cells:
            ahead.setdefault(i, []).append((j, k, s))
    beta = [[0.0] * LABELS for _ in range(n + 1)]
    for j in range(n - 1, -1, -1):
        after = ahead.get(j, ())
        for a in range(LABELS):
            rest = t[a][NOTHING] + beta[j + 1][NOTHING]
            beta[j][a] = _sum([rest, *(t[a][k] + s + beta[e][k] for e, k, s in after)]) if after else rest
    return beta


def likelihood(edge: list[int], segments: dict, truth: frozenset, w: Weights) -> tuple[float, Weights]:
    """Log probability of the true labelling of an island and its gradient.

    ``truth`` holds (kind, start, end) of its entities, each among the segments.
    """
    n, scored, t = len(edge) - 1, _scored(segments, w), _transitions(w)
    alpha, into = _forward(n, scored, t)
    beta = _backward(n, scored, t)
    z, slope = _sum(alpha[n]), {}

    def add(key: tuple, by: float) -> None:
        slope[key] = slope.get(key, 0.0) + by

    def moved(label: int, at: int, gain: float) -> None:
        """Expected transitions into ``label`` at an atom; ``gain``: what follows, less the whole."""
        for a in range(LABELS):
            if (a or label) and alpha[at][a] > _NEVER:
                add(("then", a, label), -math.exp(alpha[at][a] + t[a][label] + gain))

    for j in range(1, n + 1):
        moved(NOTHING, j - 1, beta[j][NOTHING] - z)
        for i, k, s, kind, f in scored.get(j, ()):
            p = math.exp(into[i][k] + s + beta[j][k] - z)
            moved(k, i, s + beta[j][k] - z)
            for x in f:
                add((kind, x), -p)
    at = {(kind, edge[i], edge[j]): (i, j, k, s, f) for j, cells in scored.items() for i, k, s, kind, f in cells}
    value, last, j = 0.0, NOTHING, 0
    for kind, a, b in sorted(truth, key=lambda x: x[1]):
        i, e, k, s, f = at[kind, a, b]
        for label in [NOTHING] * (i - j) + [k]:
            value += t[last][label]
            if last or label:
                add(("then", last, label), 1.0)
            last = label
        value, j = value + s, e
        for x in f:
            add((kind, x), 1.0)
    for label in [NOTHING] * (n - j):
        value += t[last][label]
        if last or label:
            add(("then", last, label), 1.0)
        last = label
    return value - z, slope


def best(text: str, w: Weights) -> list[tuple[str, int, int, float]]:
    """Entities of the best labelling of an island: (kind, start, end, probability)."""
    edge, segments = candidates(text)
    if not segments:
        return []
    n, scored, t = len(edge) - 1, _scored(segments, w), _transitions(w)
    score: list[list[float]] = [[0.0] + [_NEVER] * (LABELS - 1)]
    back: list[list] = [[None] * LABELS]
    into, from_ = [], []
    for j in range(n + 1):
        if j:
            score.append([into[j - 1][NOTHING]] + [_NEVER] * (LABELS - 1))
            back.append([(j - 1, None)] + [None] * (LABELS - 1))
            for i, k, s, kind, _ in scored.get(j, ()):
                if into[i][k] + s > score[j][k]:
                    score[j][k], back[j][k] = into[i][k] + s, (i, kind)
        source = [max(range(LABELS), key=lambda a: (score[j][a] + t[a][b], -a)) for b in range(LABELS)]
        from_.append(source)
        into.append([score[j][source[b]] + t[source[b]][b] for b in range(LABELS)])
    j, k, path = n, max(range(LABELS), key=lambda a: (score[n][a], -a)), []
    while j > 0:
        i, kind = back[j][k]
        if kind is not None:
            path.append((kind, i, j, k))
        j, k = i, from_[i][k]
    if not path:
        return []
    alpha, sums = _forward(n, scored, t)
    beta, z = _backward(n, scored, t), _sum(alpha[n])
    own = {(i, j, k): s for j, cells in scored.items() for i, k, s, _, _ in cells}
    return [(kind, edge[i], edge[j], math.exp(sums[i][k] + own[i, j, k] + beta[j][k] - z)) for kind, i, j, k in path[::-1]]


def _digits(s: str) -> str:
    return "".join(_GROUPS.findall(s))


def _ten(s: str, form: str) -> str:
    d = _digits(s)[-10:]
    return form.format(d[:3], d[3:6], d[6:])


#: Other notations that the field learns, by kind and name.
NOTATIONS = {
    ("email", "bracketed"): lambda s: s.replace("@", " [at] ").replace(".", " [dot] "),
    ("email", "round"): lambda s: s.replace("@", "(at)"),
    ("card", "dotted"): lambda s: ".".join(_digits(s)[i:i + 4] for i in range(0, len(_digits(s)), 4)),
    ("phone", "bracketed"): lambda s: _ten(s, "({}) {}-{}"),
    ("phone", "dashed"): lambda s: _ten(s, "{}-{}-{}"),
    ("phone", "dotted"): lambda s: _ten(s, "{}.{}.{}"),
}


def _windows(size: int, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """An island as a whole, or windows around its spans that cut none of them."""
    if size <= LONG:
        return [(0, size)]
    out = []
    for _, a, b in spans:
        lo, hi = max(0, a - AROUND), min(size, b + AROUND)
        lo = max([lo, *(y for _, x, y in spans if x < lo < y)])
        hi = min([hi, *(x for _, x, y in spans if x < hi < y)])
        if out and lo < out[-1][1]:
            lo = max(lo, out[-1][1]) if out[-1][1] <= a else a
        out.append((lo, hi))
    return out


def examples(text: str, without: frozenset = frozenset()) -> list[tuple[str, frozenset]]:
    """Islands of a text with their true spans, the same islands in other notations, and misleading numbers.

    ``without``: names of NOTATIONS that are kept out.
    """
    spans = sorted({x for x in base_spans(text)}, key=lambda x: (x[1], -x[2]))
    flat, end = [], -1
    for kind, a, b in spans:
        if a >= end:
            flat.append((kind, a, b))
            end = b
    out = []
    for first, last in islands(text):
        held = [(k, a - first, b - first) for k, a, b in flat if first <= a and b <= last]
        for lo, hi in ((first + x, first + y) for x, y in _windows(last - first, held)):
            inside = [(k, a - lo, b - lo) for k, a, b in flat if lo <= a and b <= hi]
            part = text[lo:hi]
            out.append((part, frozenset(inside)))
            if len(inside) == 1:
                kind, a, b = inside[0]
                for (k, name), other in NOTATIONS.items():
                    if k == kind and (k, name) not in without:
                        v = other(part[a:b])
                        out.append((part[:a] + v + part[b:], frozenset([(kind, a, a + len(v))])))
                digits = _digits(part[a:b])
                for wrong in (digits[:5], digits[:4] + "-" + digits[4:6], digits[:2] + "." + digits[2:4], digits[:3] + "," + digits[3:6],
                              digits[:-1] + str((int(digits[-1]) + 1) % 10) if kind == "card" else digits + digits if digits else ""):
                    if len(wrong) > 2 and not base_spans(wrong):
                        out.append((part[:a] + wrong + part[b:], frozenset()))
    return out


def learn(texts: list[str], epochs: int = EPOCHS, without: frozenset = frozenset()) -> Weights:
    """Weights by maximum likelihood. Islands without a segment have one labelling and teach nothing; a true span
    that is no segment of its island makes the island no example."""
    data = []
    for part, truth in dict.fromkeys((t, spans) for text in texts for t, spans in examples(text, without)):
        edge, segments = candidates(part)
        known = {(k, edge[i], edge[j]) for j, cells in segments.items() for i, k, _ in cells}
        if segments and truth <= known:
            data.append((edge, segments, truth))
    w: Weights = {}
    square: dict[tuple, float] = {}
    rough = [(edge, {j: [(i, k, [x for x in f if not x.startswith(_EXACT)]) for i, k, f in cells] for j, cells in segments.items()}, truth)
             for edge, segments, truth in data]
    for n in range(epochs):
        for edge, segments, truth in data if n % 2 else rough:
            _, slope = likelihood(edge, segments, truth, w)
            for key, g in slope.items():
                g -= L2 * w.get(key, 0.0)
                if abs(g) > 1e-6:
                    square[key] = square.get(key, 1e-2) + g * g
                    w[key] = w.get(key, 0.0) + RATE * g / math.sqrt(square[key])
    return w


def find(text: str, weights: dict[tuple[str, str], float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with those that the field adds."""
    base = base_spans(text)
    if not weights:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for lo, hi in islands(text):
        near = [x for x in taken if x[0] < hi and lo < x[1]] if taken else []
        for kind, a, b, p in best(text[lo:hi], weights):
            if p >= SURE and not any(a + lo < y and x < b + lo for x, y in near):
                added.append((kind, a + lo, b + lo))
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """Texts with base spans, at most ``most``: the least hashes of those found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [t for t in pc.fill_null(batch.column("text"), "").to_pylist() if base_spans(t)]
            # only stretches around the spans are learned from
            yield pa.record_batch([pa.array(["\n".join(t[a:b] for a, b in islands(t)) for t in keep], pa.string())], ["text"])
    near = docs.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(run, "text string")
    rows = near.distinct().orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return [r.text for r in rows]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """doc_id, base (base spans) and spans (all spans) of every text, as arrays of (kind, start, end)."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        rows = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
        for batch in batches:
            for part in textvec.steps(batch, "text"):
                found = [find(t, w) for t in pc.fill_null(part.column("text"), "").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array([rows(a) for a, _ in found], kind),
                                       pa.array([rows(b) for _, b in found], kind)], ["doc_id", "base", "spans"])
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base {span}, spans {span}")


def op4_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = personal_data(docs, learn(sample(docs)))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


ORACLE_SQL: dict[str, str] = {}
