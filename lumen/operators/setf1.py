"""Set-overlap F1 between hypothesis and reference entity sets, three levels.

Entity rows are ``(sample_id, side in {hyp, ref}, token, label, relation)``.
Levels (from the published report-scoring metric): ``simple`` matches
(token, label); ``partial`` adds whether the entity has a relation;
``complete`` adds the relation itself. Per sample and level
``F1 = 2 |H & R| / (|H| + |R|)``, 0 when either set is empty; the run score is
the mean over samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed level order and output names of the metric.
LEVELS = ["simple", "partial", "complete"]
LEVEL_NAMES = {"simple": "rg_e", "partial": "rg_er", "complete": "rg_er_bar"}


def _level_keys() -> F.Column:
    has_rel = F.col("relation").isNotNull()
    return F.array(
        F.struct(F.lit("simple").alias("level"), F.array(F.col("token"), F.col("label")).alias("key")),
        F.struct(F.lit("partial").alias("level"),
                 F.array(F.col("token"), F.col("label"), has_rel.cast("string")).alias("key")),
        F.struct(F.lit("complete").alias("level"),
                 F.array(F.col("token"), F.col("label"), F.coalesce(F.col("relation"), F.lit("\u0000"))).alias("key")),
    )


def set_f1_per_sample(entities: DataFrame, samples: DataFrame | None = None,
                      sample_col: str = "sample_id", by=()) -> DataFrame:
    """Per (sample, level): |H|, |R|, |H & R| and F1.

    Two grouped aggregations: (sample, level, key) -> side flags (duplicates
    collapse map-side), then (sample, level) -> set sizes. A hot sample is
    spread by its keys in the first shuffle and pre-combined before the second.
    ``samples`` (one row per sample id, plus ``by`` columns) adds samples with
    no entity on either side; ``by`` adds grouping columns such as a report section.
    """
    by = list(by)
    x = entities.select(*by, sample_col, (F.col("side") == "hyp").alias("_h"), F.inline(_level_keys()))
    flags = x.groupBy(*by, sample_col, "level", "key").agg(F.max(F.col("_h").cast("int")).alias("_inh"),
                                                           F.max((~F.col("_h")).cast("int")).alias("_inr"))
    sizes = flags.groupBy(*by, sample_col, "level").agg(
        F.sum("_inh").cast("long").alias("n_hyp"), F.sum("_inr").cast("long").alias("n_ref"),
        F.sum(F.col("_inh") * F.col("_inr")).cast("long").alias("n_both"))
    if samples is not None:
        grid = samples.select(*by, sample_col).distinct().select(
            *by, sample_col, F.explode(F.array(*[F.lit(lv) for lv in LEVELS])).alias("level"))
        sizes = grid.join(sizes, [*by, sample_col, "level"], "left").fillna(0, ["n_hyp", "n_ref", "n_both"])
    f1 = F.when((F.col("n_hyp") == 0) | (F.col("n_ref") == 0), F.lit(0.0)).otherwise(
        2.0 * F.col("n_both") / (F.col("n_hyp") + F.col("n_ref")))
    return sizes.withColumn("f1", f1)


def set_f1(entities: DataFrame, samples: DataFrame | None = None, sample_col: str = "sample_id",
           by=()) -> DataFrame:
    """A10: mean F1 over samples per (``by``..., level), with the metric's output name."""
    per = set_f1_per_sample(entities, samples, sample_col, by)
    names = F.create_map(*[x for lv in LEVELS for x in (F.lit(lv), F.lit(LEVEL_NAMES[lv]))])
    return per.groupBy(*by, "level").agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("n_samples")) \
              .withColumn("metric", names[F.col("level")])


def extract_entities(texts: DataFrame, extract, key_cols, text_col: str = "text",
                     batch_size: int = 64) -> DataFrame:
    """Run an injected entity extractor over text rows in Arrow batches.

    ``extract(list[str]) -> list[list[dict(token, label, relation)]]`` is the
    user's model (the reference delegates to an external scorer model). Output:
    one row per entity with the key columns; texts without entities emit none.
    """
    import pandas as pd
    from pyspark.sql import types as T

    key_cols = list(key_cols)
    key_fields = [texts.schema[c] for c in key_cols]
    out_schema = T.StructType(key_fields + [T.StructField("token", T.StringType()),
                                            T.StructField("label", T.StringType()),
                                            T.StructField("relation", T.StringType())])

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[i:i + batch_size]
                ents = extract([t if isinstance(t, str) else "" for t in chunk[text_col].tolist()])
                rows = []
                for keys, found in zip(chunk[key_cols].itertuples(index=False, name=None), ents):
                    for e in found:
                        rows.append((*keys, e.get("token"), e.get("label"), e.get("relation")))
                yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    return texts.select(*key_cols, text_col).mapInPandas(run, out_schema)
