"""Public helpers: A6/A7 counts, long-form F4, unpivot, prompt shape, label names."""

from pyspark.sql import functions as F

from lumen.functions.labels import to_long_labels
from lumen.functions.text import prompt_payload
from lumen.operators.metrics import class_histogram, distinct_count, drop_ambiguous_long
from lumen.sources.tables import normalise_label_columns


def test_class_histogram_and_distinct(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 1), ("c", 0)],
                               "g string, y int")
    h = {r["g"]: (dict(r["class_counts"]), r["can_stratify"], r["n"]) for r in class_histogram(df, ["g"]).collect()}
    assert h["a"] == ({0: 2, 1: 2}, True, 4) and h["b"][1] is False and h["c"][1] is False
    assert df.agg(distinct_count(df, "g").alias("d")).first()["d"] == 3
    assert df.agg(distinct_count(df, "g", exact=False).alias("d")).first()["d"] == 3


def test_drop_ambiguous_long(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, -1), (2, 0, 0), (2, 1, 1)], "item_id int, c int, pred int")
    assert sorted({r["item_id"] for r in drop_ambiguous_long(df).collect()}) == [2]


def test_unpivot_and_prompt_shape(spark):
    wide = spark.createDataFrame([("p1", 1.0, None)], "path string, edema double, atelectasis double")
    long = {r["condition"]: r["raw_label"] for r in to_long_labels(wide, ["path"], ["edema", "atelectasis", "nope"]).collect()}
    assert long == {"edema": 1.0, "atelectasis": None}
    df = spark.createDataFrame([("a-pt", "Chest x-ray findings:"), ("b-it", "Chest x-ray findings:")], "m string, p string")
    got = dict(df.select("m", prompt_payload("p", "m", plain_models=["a-pt"]).alias("x")).collect())
    assert got["a-pt"] == "<start_of_image>\nChest x-ray findings:"
    assert got["b-it"].startswith('[{"role":"system"') and '{"type":"image"}' in got["b-it"]


def test_label_column_names(spark):
    df = spark.createDataFrame([("x", 1.0)], "`Path` string, `Pleural Effusion` double")
    assert normalise_label_columns(df).columns == ["path", "pleural_effusion"]
    assert normalise_label_columns(df, {"Path": "Path"}).select(F.col("Path")).count() == 1
