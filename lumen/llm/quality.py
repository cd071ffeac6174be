"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one ``fail_bits`` integer (bit *i* set: rule *i* failed). Policies are
versioned masks over those bits, so a policy change, a comparison of two
versions or an ablation ("what if rule X were dropped?") is bitwise work on
the ledger and never touches a text again. Main path: Column expressions only.

Defined results: a null text counts as empty (no words); ratios over zero
word characters are 0; repeated rows give one ledger row each; an empty table
gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import read, words

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; ``failed`` is SQL that Spark and DuckDB both read."""

    name: str
    failed: str


#: Bit i of the ledger is rule i. Append only: stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("some_repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("symbols", "100 * n_symbols > 3 * word_chars"),
    Rule("capitals", "100 * n_upper > 30 * word_chars"),
    Rule("exclamation", "100 * n_bang > 5 * word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bit = {r.name: 1 << i for i, r in enumerate(RULES)}
        return sum(bit[r] for r in self.rules)


POLICIES = (
    Policy("base", 1, ("few_words", "repeated_windows")),
    Policy("prose", 1, ("few_words", "repeated_windows", "symbols", "capitals", "exclamation")),
    Policy("prose", 2, ("few_words", "repeated_windows", "repeated_lines", "symbols", "capitals",
                        "exclamation", "short_words", "long_words")),
    Policy("strict", 1, tuple(r.name for r in RULES)),
)
PRODUCTION = POLICIES[2]


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus the measurements the rules read.

    Works row by row without a shuffle: repeated 3-word windows are found by
    sorting the hashes of a document's own windows, and only for documents
    whose windows are not all distinct. Each array that a lambda reads is a
    column of its own step, so it is built once per row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, t.alias("_t"), words(F.col(text)).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^!]+", "")).cast("long").alias("n_bang"),
        lines.alias("_l"),
        F.slice(F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
                1, F.greatest(F.size("_w") - 2, F.lit(0))).alias("_h"))
    same = F.size(F.array_distinct("_h")) == F.size("_h")
    marked = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    measures = ["n_words", "word_chars", "n_symbols", "n_upper", "n_bang"]
    d = d.select(
        *keep, *measures, F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(same, F.slice(marked, 1, 0)).otherwise(F.sort_array(marked)).alias("_s"))
    twice = F.filter("_s", lambda e, j: (e["h"] == F.get("_s", j + 1)["h"])
                     | ((j > 0) & (e["h"] == F.get("_s", F.greatest(j - 1, F.lit(0)))["h"])))
    d = d.select(*keep, *measures, "n_lines", "n_dup_lines",
                 F.sort_array(F.transform(twice, lambda e: e["i"])).alias("_p"))
    # a window covers its three words; the next covered window may start inside it
    cover = F.aggregate(
        F.transform("_p", lambda x, j: F.least(F.coalesce(F.get("_p", j + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0), lambda a, x: a + x)
    return d.select(*keep, *measures, "n_lines", "n_dup_lines", cover.cast("long").alias("n_repeat_words"))


def fail_bits() -> Column:
    out = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        out = out.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    return measure(docs, text, keep).withColumn("fail_bits", fail_bits())


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One boolean column ``keep_<name>_v<version>`` per policy."""
    return led.select("*", *[passes(p).alias(f"keep_{p.name}_v{p.version}") for p in policies])


def ablate(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents failed, failed by this rule alone, and kept without it.

    The ledger is first counted by bit pattern (map-side combined); only the
    patterns, at most 2^rules, meet the policy list.
    """
    patterns = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"),
                      F.lit(r.name).alias("rule"), F.lit(p.mask).cast("long").alias("mask"),
                      F.lit(1 << i).cast("long").alias("bit"))
             for p in policies for i, r in enumerate(RULES) if r.name in p.rules]
    d = patterns.select("fail_bits", "n", F.inline(F.array(*cells)))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return d.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))
              .otherwise(0)).alias("n_kept_without"))


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policies(ledger(read(spark, sf_dir, "documents")), POLICIES)
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[0].mask).cast("long")) != 0
    return led.select("*", base.alias("base_failed"), passes(PRODUCTION).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the production policy keeps, unchanged."""
    cols = docs.columns
    led = ledger(docs.select(F.struct(*cols).alias("_row"), F.col("text")), keep=("_row",))
    # a filter on generated rows stays above the ledger; pushed down, it would repeat every rule's expressions
    led = led.select("_row", F.explode(F.array("fail_bits")).alias("fail_bits"))
    return led.where(passes(PRODUCTION)).select("_row.*")


_MEASURES_SQL = """
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, row_number() OVER () AS rid,
             list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT rid, u.i AS i, u.g AS g FROM (
        SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'g': ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]})) AS u
        FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
             CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bang,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid))"""

ORACLE_SQL = {"op1_quality_ledger": (
    f"WITH {_MEASURES_SQL.strip()},\nb AS (SELECT *, "
    + " | ".join(f"(CASE WHEN {r.failed} THEN {1 << i} ELSE 0 END)::BIGINT" for i, r in enumerate(RULES))
    + " AS fail_bits FROM m)\nSELECT *, "
    + ", ".join(f"(fail_bits & {p.mask}) = 0 AS keep_{p.name}_v{p.version}" for p in POLICIES)
    + ", n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, "
    + f"(fail_bits & {PRODUCTION.mask}) = 0 AS kept FROM b")}
