"""Aggregate metrics: F1 / macro-F1 / two-policy evaluation, exact ROC-AUC, counts.

Everything is a grouped aggregation with partial (map-side) combine, so a
hot group (one condition or one model holding a third of the rows) is
combined inside each map task before any row crosses the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.operators.broadcast import join_small
from lumen.session import cut_lineage


def _i(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("long")


def _sum_if(c: Column) -> Column:
    return F.sum(_i(c))


def f1_from_counts(tp, fp, fn) -> Column:
    """Binary F1 for the positive class, ``zero_division=0``."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((2 * tp).cast("double") / den)


def confusion_aggs(gt: Column, pred: Column, keep: Column | None = None, prefix: str = "") -> list[Column]:
    k = keep if keep is not None else F.lit(True)
    pos_t, pos_p = gt == 1, pred == 1
    return [
        _sum_if(k).alias(f"{prefix}n_rows"),
        _sum_if(k & pos_t & pos_p).alias(f"{prefix}tp"),
        _sum_if(k & ~pos_t & pos_p).alias(f"{prefix}fp"),
        _sum_if(k & pos_t & ~pos_p).alias(f"{prefix}fn"),
        _sum_if(k & pos_t).alias(f"{prefix}gt_pos"),
        _sum_if(k & pos_p).alias(f"{prefix}pred_pos"),
    ]


def f1_by(df: DataFrame, group_cols, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """A1 + A3: per-group counts and F1 in one aggregation."""
    out = df.groupBy(*group_cols).agg(*confusion_aggs(F.col(gt), F.col(pred)))
    return out.withColumn("f1", f1_from_counts("tp", "fp", "fn"))


def macro_f1(per_group: DataFrame, by=(), f1: str = "f1") -> DataFrame:
    """A2: unweighted mean of the group F1 values; 0.0 when there are none."""
    agg = [F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"), F.count(f1).alias("n_conditions")]
    return per_group.groupBy(*by).agg(*agg) if by else per_group.agg(*agg)


POLICIES = ("drop_ambiguous", "ambiguous_to_negative")


def policy_counts(items: DataFrame, answers: str = "answers", condition: str = "condition_id",
                  gt: str = "gt", pred: str = "pred") -> DataFrame:
    """A4 on the per-item form (one row per item, an array of per-condition answers).

    ``drop_ambiguous`` removes an item if *any* of its answers is -1 (F4) -- a
    row-local ``exists`` on the array, so no shuffle by item is needed.
    ``ambiguous_to_negative`` maps -1 to 0 (T15). Both policies come out of one
    aggregation pass; the result has one row per (policy, condition).
    """
    # inline_outer: a plain inline makes the optimizer infer size(answers) > 0
    # and push it below the projection, evaluating the whole answer array twice.
    x = (items.select(F.exists(answers, lambda a: a[pred] == -1).alias("_amb"), F.inline_outer(answers))
         .where(F.col(condition).isNotNull()))
    g, p = F.col(gt), F.col(pred)
    p_neg = F.when(p == -1, F.lit(0)).otherwise(p)
    agg = x.groupBy(condition).agg(*confusion_aggs(g, p, ~F.col("_amb"), "d_"),
                                   *confusion_aggs(g, p_neg, None, "n_"))
    fields = ["n_rows", "tp", "fp", "fn", "gt_pos", "pred_pos"]
    per_policy = F.array(
        F.struct(F.lit(POLICIES[0]).alias("policy"), *[F.col("d_" + f).alias(f) for f in fields]),
        F.struct(F.lit(POLICIES[1]).alias("policy"), *[F.col("n_" + f).alias(f) for f in fields]))
    out = agg.select(condition, F.inline(per_policy))
    return out.withColumn("f1", f1_from_counts("tp", "fp", "fn"))


def policy_f1(items: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(per-condition F1 rows, macro-F1 per policy). A policy that keeps no
    rows reports no per-condition F1 and a macro-F1 of 0.0, like the reference."""
    counts = policy_counts(items, **kw)
    f1_nullable = F.when(F.col("n_rows") > 0, F.col("f1"))
    per_cond = counts.where(F.col("n_rows") > 0)
    macro = (counts.groupBy("policy")
             .agg(F.coalesce(F.avg(f1_nullable), F.lit(0.0)).alias("macro_f1"),
                  F.count(f1_nullable).alias("n_conditions"),
                  F.max("n_rows").alias("n_items")))
    return per_cond, macro


def ambiguous_items_long(df: DataFrame, item: str = "item_id", pred: str = "pred") -> DataFrame:
    """F4 for long tables: items with any ambiguous answer (one grouped pass)."""
    return df.groupBy(item).agg(F.bool_or(F.col(pred) == -1).alias("_amb")).where("_amb").select(item)


def drop_ambiguous_long(df: DataFrame, item: str = "item_id", pred: str = "pred") -> DataFrame:
    return df.join(ambiguous_items_long(df, item, pred), item, "left_anti")


# ---------------------------------------------------------------- ROC-AUC (A5)

def _score_counts(df: DataFrame, group_cols, label: str, score: str) -> DataFrame:
    y = F.col(label)
    return (df.where(F.col(score).isNotNull())
            .groupBy(*group_cols, F.col(score).cast("double").alias("_s"))
            .agg(_sum_if(y == 1).alias("_p"), _sum_if(y == 0).alias("_q"), F.count(F.lit(1)).alias("_r")))


def _bucket_by_cuts(counts: DataFrame, keys, n: int, accuracy: int, out: str, bound: int) -> DataFrame:
    """Bucket index of ``_s`` among ``n`` approximate quantiles per ``keys`` (ties stay together).
    ``bound`` is the number of distinct ``keys`` (rows of the cut-point table)."""
    probs = [i / n for i in range(1, n)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_s", probs, accuracy).alias("_cuts"))
    return (join_small(counts, cuts, list(keys), bound=bound, row_bytes=8 * n + 64)
            .withColumn(out, F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts"))


def auc_by(df: DataFrame, group_cols, label: str = "y", score: str = "score",
           buckets: int | None = None, accuracy: int = 10000, materialize: bool = True,
           rows_per_bucket: int = 2_000_000, max_fanout: int = 64) -> DataFrame:
    """Exact tie-corrected ROC-AUC per group (Mann-Whitney form).

    ``AUC = sum_s p_s * (cq_s + q_s / 2) / (P * N)`` where, per distinct score
    ``s``, ``p_s``/``q_s`` count positives/negatives and ``cq_s`` counts negatives
    strictly below ``s``. Computed without putting a whole group in one task:

    1. pre-aggregate to one row per (group, distinct score) -- a hot score or a
       hot group collapses in the map-side combine;
    2. split each group's distinct scores into buckets at approximate quantile
       cut points; a score maps to one bucket, so ties never straddle buckets.
       ``buckets=None`` sizes the split from the largest group so a bucket holds
       about ``rows_per_bucket`` distinct scores; above ``max_fanout`` buckets a
       second level of cut points splits every coarse bucket, keeping the
       lookup at ``2 * max_fanout`` comparisons per row;
    3. per (group, bucket) negative totals -> running offsets over the (few)
       buckets of a group;
    4. running sum of negatives inside each (group, bucket) plus its offset.

    The numerator is an exact integer, so the value does not depend on
    partitioning. One-class groups give null. ``n_rows`` counts every scored
    row of the group (labels other than 0/1 included).
    """
    import math

    group_cols = list(group_cols)
    counts = _score_counts(df, group_cols, label, score)
    if materialize:
        # Several consumers read the pre-aggregated table (sizing, cut points,
        # bucket totals, running sums). Writing it once to the shared checkpoint
        # folder beats re-scanning and re-aggregating the raw scores each time,
        # and survives executor loss.
        counts = cut_lineage(counts)
    # Sizing pass (on the materialised table): the largest group sizes the
    # buckets, the group count bounds every small table joined below.
    sizes = counts.groupBy(*group_cols).count().agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("g")).first()
    largest, n_groups = int(sizes["m"] or 0), int(sizes["g"] or 0)
    if buckets is None:
        buckets = max(1, math.ceil(largest / rows_per_bucket))
    if buckets > 1:
        b1 = min(buckets, max_fanout)
        counts = _bucket_by_cuts(counts, group_cols, b1, accuracy, "_b1", n_groups)
        if buckets > max_fanout:
            b2 = math.ceil(buckets / max_fanout)
            counts = _bucket_by_cuts(counts, group_cols + ["_b1"], b2, accuracy, "_b2", n_groups * b1)
            counts = counts.withColumn("_b", F.col("_b1") * b2 + F.col("_b2")).drop("_b1", "_b2")
        else:
            counts = counts.withColumnRenamed("_b1", "_b")
    else:
        counts = counts.withColumn("_b", F.lit(0))
    per_bucket = counts.groupBy(*group_cols, "_b").agg(F.sum("_q").alias("_qb"))
    below = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*group_cols, "_b",
                                F.coalesce(F.sum("_qb").over(below), F.lit(0)).alias("_qoff"))
    counts = join_small(counts, offsets, group_cols + ["_b"], bound=n_groups * max(1, buckets))
    inside = Window.partitionBy(*group_cols, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    cq = F.col("_qoff") + F.coalesce(F.sum("_q").over(inside), F.lit(0))
    contrib = counts.select(*group_cols, "_p", "_q", "_r", (F.col("_p").cast("decimal(38,0)") * (2 * cq + F.col("_q"))).cast("decimal(38,0)").alias("_num"))
    out = contrib.groupBy(*group_cols).agg(
        F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum("_r").alias("n_rows"),
        F.sum("_num").alias("_num"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_num").cast("double") / (2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
    return out.select(*group_cols, "n_pos", "n_neg", "n_rows", auc.alias("auc"))


# ---------------------------------------------------------------- counts

def class_histogram(df: DataFrame, group_cols, label: str = "y") -> DataFrame:
    """Per-group class counts plus ``can_stratify`` (more than one class slot
    and every non-empty class has at least two rows, as ``np.bincount`` sees it)."""
    h = df.groupBy(*group_cols, label).count()
    return h.groupBy(*group_cols).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("count")))).alias("class_counts"),
        ((F.max(label) >= 1) & (F.min("count") >= 2)).alias("can_stratify"),
        F.sum("count").alias("n"))


def distinct_count(df: DataFrame, col: str, exact: bool = True) -> Column:
    """Distinct count (exact, or HyperLogLog++ when ``exact=False``)."""
    return F.countDistinct(col) if exact else F.approx_count_distinct(col)


#: Registers of a distinct sketch as a power of two: 4 KB a sketch, standard error 1.6 %.
SKETCH_BITS = 12


def distinct_counts(df: DataFrame, col: str, by=()) -> DataFrame:
    """Rows and exact distinct values of ``col`` per group, with a mergeable sketch of the values."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.countDistinct(col).alias("n_distinct"),
            F.hll_sketch_agg(col, SKETCH_BITS).alias("sketch")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def merge_distinct_counts(parts: DataFrame, by=()) -> DataFrame:
    """Totals over stored parts of ``distinct_counts``: rows exactly, distinct values from the merged sketches."""
    aggs = [F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct_estimate")]
    return parts.groupBy(*by).agg(*aggs) if by else parts.agg(*aggs)
