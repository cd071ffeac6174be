"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are values assigned to a credential's name, and long tokens with
letters and digits. Each gets features: length, character classes and the
changes between them, entropy, coverage by a dictionary of the corpus's own
frequent words, path marks before it, and its neighbouring words. A forest
trained from labelled findings gives each a probability. The main path is
Column expressions and MLlib on DataFrames.

Labelled findings of the query: no table has them, so findings that are certain
by their surroundings are labelled (a varied value assigned to a credential's
name or after "Bearer", a key with its issuer's prefix; a part of an address or
path, a placeholder, dictionary words, a named checksum), and the certain
secrets are also shown under other and longer names, as checksums, and behind
an issuer's prefix in prose and addresses, where they stay secrets. At most SAMPLE of each kind train, least hash
first; ``train`` takes any other labelled findings as well.

Defined results: null and empty texts have no candidates; repeated rows are
scored each; with findings of one label only there is no forest and every
candidate keeps probability 1; an empty table gives an empty result; other
columns are not read (the pipeline stage hands them on).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import materialise, most_frequent, read

#: Labelled findings of each kind that train the forest, at most.
SAMPLE = 1000
DICTIONARY = 4096
TREES, DEPTH, SEED = 24, 6, 11
THRESHOLD = 0.5
BEFORE, AFTER = 60, 30

_CREDENTIAL = "token|secret|password|passwd|pwd|api_key|apikey|access_key|auth"
_BEARER = r"(?i)\bbearer +$"
#: Prefixes that issuers give their keys, and the marks of a key in an address.
_KNOWN_KEY = (r"(^|[/=.~])((AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}"
              r"|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})($|[/=.~,;&])")
_CHECKSUM = ("commit", "sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "etag", "uuid", "guid", "rev", "build")
_PLACEHOLDER = r"(?i)example|changeme|placeholder|your|x{4}|\*{4}|0{6}|123456"
_T = "A-Za-z0-9+/_=.~-"
CANDIDATE = (
    rf"""(?<=[=:] {{0,1}}["']{{0,1}})(?<=(?i:{_CREDENTIAL})["']{{0,1}} {{0,1}}[=:] {{0,1}}["']{{0,1}})[^\s"'<>]{{8,}}+"""
    rf"|(?<![{_T}])(?=[{_T}]*[0-9])(?=[{_T}]*[A-Za-z])[{_T}]{{16,}}+")

FEATURES = ("n_chars", "changes", "digits", "upper", "lower", "hex", "entropy", "variety", "coverage", "slashes", "dots",
            "in_path", "in_address", "assigned", "quoted", "credential", "known_key", "checksum", "placeholder")


def found(text: Column) -> Column:
    """Candidates of a text: array of (start, value, before, after), start in code points."""
    parts, values = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), 0)

    def build(p: Column, v: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(p, i))
            return F.struct((start + F.length(F.get(v, i))).alias("at"), F.concat(s["starts"], F.array(start)).alias("starts"))
        starts = F.aggregate(F.transform(v, lambda _, i: i), zero, step)["starts"]
        return F.zip_with(starts, F.transform(v, lambda x, i: F.struct(
            x.alias("value"), F.substring(F.get(p, i), -BEFORE, BEFORE).alias("before"),
            F.substring(F.get(p, i + 1), 1, AFTER).alias("after"))),
            lambda a, x: F.struct(a.alias("start"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))
    # each of the two arrays is built once and bound by its lambda; texts without a match stop at the first
    bound = F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, F.transform(
        F.array(parts), lambda p: build(p, v))[0]))[0]
    return F.coalesce(bound, F.array().cast("array<struct<start:int,value:string,before:string,after:string>>"))


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return docs.select(*keep, F.inline(found(F.col("text"))))


def dictionary(docs: DataFrame) -> list[str]:
    """The corpus's most frequent words of three letters and more, at most DICTIONARY."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("c")), "dictionary")
    return sorted(r.word for r in most_frequent(counts, "c", DICTIONARY).select("word").collect())


def describe(found_: DataFrame, words: list[str]) -> DataFrame:
    """``found_`` plus the feature columns."""
    v, n = F.col("value"), F.length("value")
    kept = lambda drop: F.length(F.regexp_replace("value", drop, "")) / n
    known = F.split(F.lit(",".join(words)), ",")
    runs = F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), 0)
    covered = F.transform(F.array(known), lambda k: F.aggregate(
        F.filter(runs, lambda r: F.array_contains(k, r)), F.lit(0), lambda a, r: a + F.length(r)))[0]
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    shares = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n)
    last = F.lower(F.regexp_extract("before", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    classes = r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+"
    return found_.withColumns({
        "n_chars": n.cast("double"),
        "changes": (F.size(F.regexp_extract_all("value", F.lit(classes), 0)) - 1) / n,
        "digits": kept("[^0-9]"), "upper": kept("[^A-Z]"), "lower": kept("[^a-z]"),
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "variety": F.size(F.array_distinct(chars)) / n,
        "coverage": covered / n,
        "slashes": kept("[^/]"), "dots": kept("[^.]"),
        "in_path": flag(F.col("before").rlike(r"(/|://\S*)$")),
        "in_address": flag(F.col("before").rlike(r"@$") | F.col("after").rlike("^@")),
        "assigned": flag(F.col("before").rlike(r"""[=:] ?["']?$""")),
        "quoted": flag(F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")),
        "credential": flag(last.rlike(f"({_CREDENTIAL})$") | F.col("before").rlike(_BEARER)),
        "known_key": flag(v.rlike(_KNOWN_KEY)),
        "checksum": flag(last.isin(*_CHECKSUM)),
        "placeholder": flag(v.rlike(_PLACEHOLDER)),
    })


def certain(described: DataFrame) -> DataFrame:
    """Findings that their surroundings decide, with ``label`` 1 or 0."""
    named = (F.col("credential") + F.col("assigned") == 2) | F.col("before").rlike(_BEARER) | (F.col("known_key") == 1)
    yes = named & (F.col("entropy") >= 2.5) & (F.col("placeholder") == 0) & (F.col("coverage") < 0.5)
    no = (F.col("in_path") + F.col("in_address") + F.col("placeholder") + F.col("checksum") > 0) | (F.col("coverage") >= 0.6)
    return described.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")


def _shown_elsewhere(yes: DataFrame) -> DataFrame:
    """Certain secrets in other surroundings: still secrets, or checksums and placeholders."""
    def near(before: str, after: str, label: float, value: Column | None = None) -> Column:
        return F.struct((F.col("value") if value is None else value).alias("value"), F.lit(before).alias("before"),
                        F.lit(after).alias("after"), F.lit(label).alias("label"))
    shown = [near('password: "', '"', 1.0), near("secret=", " ", 1.0), near("api_key = '", "'", 1.0), near("auth: ", "", 1.0),
             near("GITHUB_TOKEN=", "", 1.0), near("export DB_PASSWORD='", "'", 1.0), near("Authorization: Bearer ", "", 1.0)]
    # shorter values of a larger alphabet
    mixed = F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2("value", 256))), "[+/=]", ""), 1, 16)
    shown += [near(b, a, 1.0, mixed) for b, a in (("password: '", "'"), ("DB_PASSWORD: '", "'"), ("GITHUB_TOKEN=", " "), ("secret = \"", "\""))]
    # the same values behind an issuer's prefix are secrets in any surroundings
    issued = {"AKIA": F.upper(F.substring(F.sha2("value", 256), 1, 16)), "ghp_": F.substring(F.sha2("value", 256), 1, 36),
              "sk_live_": F.substring(F.sha2("value", 256), 1, 24)}
    shown += [near(b, a, 1.0, F.concat(F.lit(front + p), v)) for p, v in issued.items()
              for b, front, a in ((" the ", "", " and"), ("see https:", "//a.example/", " "), ("https://a.example/x?", "key=", " "), ("", "", ""))]
    shown += [near(f"{w} ", " of", 0.0) for w in _CHECKSUM] + [near("see https://a.example/", "/", 0.0, F.sha1("value"))]
    shown += [near('token = "', '"', 0.0, F.concat(F.lit(p), F.substring("value", 1, 6))) for p in ("your_", "example", "xxxxxxxx")]
    # every kind of name also has placeholders
    shown += [near(b, a, 0.0, F.concat(F.lit(p), F.substring("value", 1, 6))) for p in ("your_token_here_", "changeme_", "example_")
              for b, a in (('token = "', '"'), ("password: '", "'"), ("DB_PASSWORD: '", "'"), ("GITHUB_TOKEN=", " "), ('secret = "', '"'))]
    return yes.select(F.inline(F.array(*shown)))


def sample(described: DataFrame, words: list[str], most: int = SAMPLE) -> DataFrame:
    """Labelled findings for training: at most ``most`` of each label, and the secrets elsewhere."""
    known = certain(described).select("value", "before", "after", "label").distinct()
    least = lambda label: known.where(F.col("label") == label).orderBy(F.xxhash64("value", "before"), "after").limit(most)
    yes = materialise(least(1.0), "certain")
    return describe(yes.unionByName(least(0.0)).unionByName(_shown_elsewhere(yes)), words)


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from findings with features and ``label``; None unless both labels occur."""
    d = materialise(labelled.select(*FEATURES, F.col("label").cast("double").alias("label"))
                    .coalesce(1).sortWithinPartitions("label", *FEATURES), "labelled")
    if d.select("label").distinct().count() < 2:
        return None
    d = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(d)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(d)


def judge(described: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``described`` plus ``probability`` and ``secret``."""
    if model is None:
        return described.withColumn("probability", F.lit(1.0)).withColumn("secret", F.lit(True))
    d = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)
    m = model.setProbabilityCol("_odds").setRawPredictionCol("").setPredictionCol("")
    p = vector_to_array("_odds")[1]
    return m.transform(d).withColumn("probability", p).withColumn("secret", p >= THRESHOLD).drop("features", "_odds")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All candidates of ``docs`` with features, probability and verdict."""
    words = dictionary(docs)
    described = materialise(describe(candidates(docs, keep), words), "candidates")
    return judge(described, train(sample(described, words)))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", (F.col("start") + F.length("value")).alias("end"), F.sha2("value", 256).alias("value_sha256"),
        *FEATURES, "probability", "secret")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """``text`` with the (start, end) spans, sorted and disjoint, replaced."""
    s = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, x: F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(by)).alias("out"), x["end"].alias("at")))
    return F.transform(F.array(s), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))[0]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with confirmed secrets masked in ``text`` and ``n_chars``, where present, counted anew.

    Texts without a candidate are handed on; only the others are regrouped.
    """
    cols = docs.columns
    d = docs.withColumn("_row", F.struct(F.monotonically_increasing_id().alias("id"), F.struct(*cols).alias("of")))
    d = d.select("_row", "text").withColumn("_found", F.col("text").rlike(CANDIDATE))
    plain = d.where("not coalesce(_found, false)").select("_row.of.*")
    # candidates carry their row's id; verdicts are gathered by it (a row's candidates only)
    some = materialise(d.where("_found").select("_row"), "flagged")
    flagged = some.select(F.col("_row.id").alias("doc_id"), F.col("_row.of.text").alias("text"))
    words = dictionary(docs)
    described = materialise(describe(candidates(flagged), words), "candidates")
    judged = judge(described, train(sample(described, words))).where("secret")
    end = (F.col("start") + F.length("value")).alias("end")
    spans = judged.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", end))).alias("_spans"))
    joined = some.join(spans, some["_row.id"] == spans["_id"], "left")
    text = F.when(F.col("_spans").isNotNull(), mask(F.col("_row.of.text"), F.col("_spans"))).otherwise(F.col("_row.of.text"))
    out = joined.select("_row.of", text.alias("_text")).select(*[F.col("_text").alias(c) if c == "text" else
                        F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"of.`{c}`") for c in cols])
    return plain.unionByName(out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, confirmed secrets masked."""
    return redact(docs)


ORACLE_SQL: dict[str, str] = {}
