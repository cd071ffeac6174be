"""A13 target sizes and N1 exact-size stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.session import cut_lineage

# Fixed defaults of the reference's probe training.
DEFAULT_SAMPLE_SIZES = [64, 512, 4096]
DEFAULT_MIN_OVERAGE_RATIO = 1.5
DEFAULT_SEED = 42


def target_sizes(counts: DataFrame, sizes=DEFAULT_SAMPLE_SIZES, ratio: float = DEFAULT_MIN_OVERAGE_RATIO,
                 n_col: str = "n") -> DataFrame:
    """A13/F10/D2 per row of ``counts`` (one row per group with its available ``n``).

    Valid sizes are the distinct requested sizes with ``0 < s <= n``, sorted;
    the full size ``n`` is appended when ``n >= last * ratio`` and not already
    present; with no valid size the plan is ``[n]``. Row-local array
    expressions -- no join, no shuffle. Output adds ``size_ordinal``,
    ``sample_size`` and ``is_full``.
    """
    n = F.col(n_col)
    req = F.array(*[F.lit(int(s)).cast("long") for s in sizes])
    valid = F.array_sort(F.array_distinct(F.filter(req, lambda s: (s > 0) & (s <= n))))
    last = F.element_at(valid, -1)
    plan = (F.when(F.size(valid) == 0, F.array(n.cast("long")))
            .when((n >= last * F.lit(ratio)) & ~F.array_contains(valid, n.cast("long")),
                  F.concat(valid, F.array(n.cast("long"))))
            .otherwise(valid))
    keep = [c for c in counts.columns]
    return (counts.select(*keep, F.posexplode(plan).alias("size_ordinal", "sample_size"))
            .withColumn("is_full", F.col("sample_size") == n))


def _u01(key_cols, seed: int):
    """Deterministic uniform in [0, 1) from the row key and seed (partition-independent)."""
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))
    return (F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53))


# Class id of the single pseudo-class used when a group cannot be stratified.
ALL_CLASSES = -(1 << 62)


def _class_table(df: DataFrame, group_cols, label: str) -> DataFrame:
    """The one aggregation over the big table: rows per (group, label), plus the
    sampling class of each label (A7: a group is stratified when it has more
    than one class slot and every non-empty class has >= 2 rows; otherwise all
    its labels share the pseudo-class ``ALL_CLASSES``)."""
    return _classes(df.groupBy(*group_cols, label).agg(F.count(F.lit(1)).alias("_c")), group_cols, label)


def _classes(h: DataFrame, group_cols, label: str) -> DataFrame:
    """Sampling class of each (group, label) of a count table ``_c``."""
    g = Window.partitionBy(*group_cols)
    strat = (F.max(label).over(g) >= 1) & (F.min("_c").over(g) >= 2)
    return h.withColumn("_cls", F.when(strat, F.col(label).cast("long")).otherwise(F.lit(ALL_CLASSES)))


def class_quotas(df: DataFrame, plan: DataFrame, group_cols, label: str,
                 classes: DataFrame | None = None) -> DataFrame:
    """Per (group, sample_size, class) quota by largest remainder (exact integers).

    Non-stratifiable groups are sampled as one pseudo-class (``ALL_CLASSES``),
    like the reference's fallback to a plain random split. Ties between equal
    remainders go to the larger class, then the smaller label. Everything here
    runs on the small per-(group, label) count table.
    """
    group_cols = list(group_cols)
    t = classes if classes is not None else _class_table(df, group_cols, label)
    h = t.groupBy(*group_cols, "_cls").agg(F.sum("_c").alias("_c"))
    q = plan.select(*group_cols, "sample_size").join(h, group_cols)
    per = Window.partitionBy(*group_cols, "sample_size")
    q = q.withColumn("_n", F.sum("_c").over(per))
    num = F.col("sample_size") * F.col("_c")
    q = q.withColumn("_fl", F.call_function("div", num, F.col("_n"))).withColumn("_rem", num % F.col("_n"))
    rank_w = per.orderBy(F.col("_rem").desc(), F.col("_c").desc(), F.col("_cls").asc())
    q = (q.withColumn("_deficit", F.col("sample_size") - F.sum("_fl").over(per))
          .withColumn("_rank", F.row_number().over(rank_w))
          .withColumn("quota", F.col("_fl") + F.when(F.col("_rank") <= F.col("_deficit"), 1).otherwise(0)))
    return q.select(*group_cols, "sample_size", "_cls", "_c", "_n", "quota")


#: Equal-width bins of the hash in which a class is counted and ranked: a window holds a 65,536th of a class.
RANK_BINS = 1 << 16


def nested_ranks(df: DataFrame, plan: DataFrame, group_cols, label: str, key_cols,
                 seed: int = DEFAULT_SEED, bins: int = RANK_BINS) -> DataFrame:
    """One draw for all sizes of ``plan``: the sampled rows of ``df`` with ``sizes``, the sample sizes that hold them.

    Every class of a group is ranked once by the keyed hash; a sample of a size
    takes the rows whose rank is within the class's quota for it, so samples are
    nested up to the rounding of quotas. Exactly ``sample_size`` rows, quotas by
    largest remainder, the same rows for any partitioning. Rows are counted in
    ``bins`` bins of the hash (one aggregation, which also gives the class
    counts), only bins that reach below the largest quota are joined, and a rank
    is the rows of lower bins plus the row number in the bin, so no window grows
    beyond a bin and the join keys are spread evenly. Groups that cannot be
    stratified are ranked as one class. ``df`` should be narrow.
    """
    group_cols, key_cols = list(group_cols), list(key_cols)
    rows = df.withColumn("_u", _u01(key_cols, seed)).withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    fine = cut_lineage(rows.groupBy(*group_cols, label, "_bin").agg(F.count(F.lit(1)).alias("_n")))
    table = cut_lineage(_classes(fine.groupBy(*group_cols, label).agg(F.sum("_n").alias("_c")), group_cols, label))
    quotas = class_quotas(df, plan, group_cols, label, table)
    cells = quotas.groupBy(*group_cols, "_cls").agg(
        F.collect_list(F.struct("sample_size", "quota", (F.col("quota") >= F.col("_c")).alias("whole"))).alias("_cells"),
        F.max("quota").alias("_most"))
    below = Window.partitionBy(*group_cols, "_cls").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    labelled = fine.join(table.select(*group_cols, label, "_cls"), group_cols + [label])
    below_most = (labelled.groupBy(*group_cols, "_cls", "_bin").agg(F.sum("_n").alias("_n"))
                  .withColumn("_off", F.coalesce(F.sum("_n").over(below), F.lit(0))))
    below_most = below_most.join(cells, group_cols + ["_cls"]).where(F.col("_off") < F.col("_most"))
    drawn = (labelled.select(*group_cols, label, "_cls", "_bin")
             .join(below_most.select(*group_cols, "_cls", "_bin", "_off", "_cells"), group_cols + ["_cls", "_bin"]))
    w = Window.partitionBy(*group_cols, "_cls", "_bin").orderBy("_u", *key_cols)
    ranked = rows.join(drawn, group_cols + [label, "_bin"]).withColumn("_rank", F.col("_off") + F.row_number().over(w))
    sizes = F.expr("transform(filter(_cells, c -> c.whole OR _rank <= c.quota), c -> c.sample_size)")
    return ranked.withColumn("sizes", sizes).where(F.size("sizes") > 0).select(*df.columns, "sizes")


def stratified_exact(df: DataFrame, plan: DataFrame, group_cols, label: str, key_cols,
                     seed: int = DEFAULT_SEED, bins: int = RANK_BINS) -> DataFrame:
    """For every (group, sample_size) of ``plan`` exactly ``sample_size`` rows of ``df``, by ``nested_ranks``."""
    drawn = nested_ranks(df, plan, group_cols, label, key_cols, seed, bins)
    return drawn.select(*df.columns, F.explode("sizes").alias("sample_size"))
