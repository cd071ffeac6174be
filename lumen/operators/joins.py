"""Best-key join, and J5 optional metadata join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.operators.broadcast import join_small, materialize_small
from lumen.session import cut_lineage

# Fixed candidate key pairs (embedding side, label side), in priority order.
DEFAULT_CANDIDATES = [("path", "path"), ("source_image_path", "path"), ("path_short", "path_short")]


#: Keys cut out of a path: a null path has none, so nulls do not match there.
DERIVED_KEYS = ("path_short",)


def _equal(a, b, key: str):
    return a == b if key in DERIVED_KEYS else a.eqNullSafe(b)


@dataclass
class JoinInfo:
    matched_rows: int
    embedding_join_key: str
    label_join_key: str
    embedding_rows_total: int
    label_rows_total: int
    null_key_rows: int = 0  # of the matched rows, those whose key is null on both sides


#: Rows of one key, on one side, that a task of the join takes; a key with more is split.
ROWS_PER_TASK = 200_000


def key_counts(left: DataFrame, right: DataFrame, candidates=DEFAULT_CANDIDATES) -> tuple[DataFrame, list[int]]:
    """Pass 1: ``(ordinal, key, n_left, n_right)`` of every applicable candidate, and their ordinals.

    Per candidate each side is pre-aggregated to ``(key, count)`` and the count
    tables are joined (full outer); nothing wide is materialised. Keys are text.
    """
    parts, used = [], []
    for i, (lk, rk) in enumerate(candidates):
        if lk not in left.columns or rk not in right.columns:
            continue
        cl = left.groupBy(F.col(lk).cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("_cl"))
        cr = right.groupBy(F.col(rk).cast("string").alias("_r")).agg(F.count(F.lit(1)).alias("_cr"))
        both = cl.join(cr, _equal(cl["_l"], cr["_r"], lk), "full")
        parts.append(both.select(F.lit(i).alias("ordinal"), F.coalesce("_l", "_r").alias("key"),
                                 F.coalesce("_cl", F.lit(0)).cast("long").alias("n_left"),
                                 F.coalesce("_cr", F.lit(0)).cast("long").alias("n_right")))
        used.append(i)
    if not parts:
        raise ValueError("no candidate join key is present on both sides")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, used


def _totals(counts: DataFrame, used, candidates) -> DataFrame:
    """One row per applicable candidate: matched rows (null keys apart as well) and the sizes of both sides."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(i, *candidates[i]) for i in used],
                                  "ordinal int, embedding_join_key string, label_join_key string")
    matched = F.col("n_left") * F.col("n_right")
    sums = counts.groupBy("ordinal").agg(
        F.sum(matched).alias("matched_rows"), F.sum(F.when(F.col("key").isNull(), matched)).alias("null_matches"),
        F.sum("n_left").alias("left_rows"), F.sum("n_right").alias("right_rows"))
    zero = F.lit(0).cast("long")
    return names.join(sums, "ordinal", "left").select(
        "ordinal", "embedding_join_key", "label_join_key",
        *[F.coalesce(c, zero).alias(c) for c in ("matched_rows", "left_rows", "right_rows", "null_matches")])


def candidate_counts(left: DataFrame, right: DataFrame, candidates=DEFAULT_CANDIDATES) -> DataFrame:
    """Matched-row count of every applicable candidate, without running the joins.

    Many-to-many matches are counted exactly (duplicates included; nulls match
    nulls as in pandas, except on keys derived from a path). All candidates run
    in one job, which also yields both table sizes.
    """
    return _totals(*key_counts(left, right, candidates), candidates)


#: Most lines of the grid on a side of a key whose rows are folded.
FOLDED_LINES = 16


def split_key_join(left: DataFrame, right: DataFrame, lk: str, rk: str, counts: DataFrame,
                   rows_per_task: int = ROWS_PER_TASK, sums: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Inner join on ``left.lk = right.rk`` in which no task holds more than about ``rows_per_task`` rows a side of one key.

    ``counts`` are the (key, n_left, n_right) of this pair of keys. A key with
    more rows is dealt to a grid of ``ceil(n_left / rows_per_task)`` by
    ``ceil(n_right / rows_per_task)`` cells: its left rows go to one column of
    cells by a hash of the row, its right rows to one line, so every pair meets
    in one cell. All other keys are a grid of one cell. There are at most
    ``rows / rows_per_task`` such keys. Rows that are equal in all columns share
    a cell. The hash makes a repeated task give the same rows.

    ``sums`` names the left and the right columns of which only sums over the
    pairs of a key are wanted. The rows of a key on one line of the grid (at
    most FOLDED_LINES lines a side) are then folded, before the lines meet, to
    one row of their number and sums. The result has the key, ``n_rows`` and
    ``sum_<column>``, one row for each pair of lines, to be added up by key: its
    rows and those met on the way grow with the inputs, not with the pairs.
    """
    def cells(n):
        c = F.ceil(F.col(n) / F.lit(rows_per_task))
        return (c if sums is None else F.least(c, F.lit(FOLDED_LINES))).cast("int")

    hot = (counts.where((F.col("n_left") > 0) & (F.col("n_right") > 0)
                        & ((F.col("n_left") > rows_per_task) | (F.col("n_right") > rows_per_task)))
           .select(F.col("key").alias("_hot"), cells("n_left").alias("_sl"), cells("n_right").alias("_sr")))
    hot, n = materialize_small(hot)
    if n == 0 and sums is None:
        return left.join(right, _equal(left[lk], right[rk], lk), "inner")

    def dealt(df, key, mine, other, at, to, side):
        """``at``: the row's own line of the grid; ``to``: all cells of that line."""
        own = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(mine)), F.lit(0)).cast("int")
        j = join_small(df, hot, _equal(df[key].cast("string"), hot["_hot"], lk), "left", bound=n, row_bytes=1024)
        lines, keep = F.coalesce(F.col(other), F.lit(1)), df.columns
        j = j.select(*keep, own.alias(at), lines.alias("_lines"))
        if sums is not None:
            j = j.groupBy(key, at, "_lines").agg(
                F.count(F.lit(1)).alias(f"_n{side}"), *[F.sum(c).alias(f"_sum{side}_{c}") for c in sums[side]])
            keep = [c for c in j.columns if c not in (at, "_lines")]
        return j.select(*keep, at, F.explode(F.sequence(F.lit(0), F.col("_lines") - 1)).alias(to)).alias(at)

    a = dealt(left, lk, "_sl", "_sr", "_i", "_j", 0)
    b = dealt(right, rk, "_sr", "_sl", "_j2", "_i2", 1)
    j = a.join(b, _equal(a[lk], b[rk], lk) & (F.col("_i") == F.col("_i2")) & (F.col("_j") == F.col("_j2")), "inner")
    if sums is None:
        return j.drop("_i", "_j", "_i2", "_j2")
    # each row of a line meets all rows of the other
    return j.select(a[lk], b[rk], (F.col("_n0") * F.col("_n1")).alias("n_rows"),
                    *[(F.col(f"_sum{i}_{c}") * F.col(f"_n{1 - i}")).alias(f"sum_{c}") for i in (0, 1) for c in sums[i]])


def best_key_join(left: DataFrame, right: DataFrame, candidates=DEFAULT_CANDIDATES,
                  suffix: str = "_label", label_side: str = "left",
                  rows_per_task: int = ROWS_PER_TASK,
                  sums: tuple[list[str], list[str]] | None = None) -> tuple[DataFrame, JoinInfo]:
    """Join on the candidate key pair with the most matched rows (earliest wins ties).

    Pass 1 counts keys and is written once; pass 2 is a single inner join on
    the winner, its hot keys (a null key among them) split by those counts.
    Right-hand columns that collide with left-hand ones get ``suffix`` (J8):
    with ``label_side="left"`` a condition present on both sides resolves to the
    embedding side, as in the reference; ``"right"`` prefers the label table.
    Raises when nothing matches (F9). With ``sums`` (left columns, right columns
    by their own names) the result holds sums over the pairs, see ``split_key_join``.
    """
    counts, used = key_counts(left, right, candidates)
    counts = cut_lineage(counts)
    best = None
    for r in sorted(_totals(counts, used, candidates).collect(), key=lambda r: r["ordinal"]):  # one row per candidate
        if best is None or r["matched_rows"] > best["matched_rows"]:
            best = r
    if best is None or best["matched_rows"] == 0:
        raise ValueError("could not match embeddings to labels on any candidate key: "
                         + ", ".join(f"{a}->{b}" for a, b in candidates))
    lk, rk = best["embedding_join_key"], best["label_join_key"]
    lcols = set(left.columns)
    names = {}
    for c in right.columns:
        if c == rk and lk == rk:
            names[c] = "_rkey"  # one key column survives, as in a same-name merge
        elif c in lcols:
            names[c] = c + suffix
        else:
            names[c] = c
    rr = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = split_key_join(left, rr, lk, names[rk], counts.where(F.col("ordinal") == best["ordinal"]), rows_per_task,
                            None if sums is None else (sums[0], [names[c] for c in sums[1]]))
    if lk == rk:
        joined = joined.drop("_rkey")
    if label_side == "right" and sums is None:
        for c in right.columns:
            if c in lcols and c != rk:
                joined = joined.withColumn(c, F.col(c + suffix))
    info = JoinInfo(int(best["matched_rows"]), lk, rk, int(best["left_rows"]), int(best["right_rows"]), int(best["null_matches"]))
    return joined, info


def attach_metadata(models: DataFrame, meta: DataFrame, key: str = "model_name") -> DataFrame:
    """Optional per-model metadata, left outer on the model name."""
    return models.join(meta, key, "left")
