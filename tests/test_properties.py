"""Property tests: L2 normalisation, forms of the verdict parser on generated text."""

import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumen.functions.vectors import l2_norm, l2_normalize
from lumen.functions.verdict import parse_verdict, with_verdict, with_verdict_array


def test_l2_normalised_vectors_have_unit_norm(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 10 ** rnd.randint(-3, 3)) for _ in range(rnd.randint(1, 40))]) for i in range(300)]
    rows.append((999, [0.0, 0.0]))  # zero vector stays zero (eps guard)
    df = spark.createDataFrame(rows, "i int, v array<double>")
    out = {r["i"]: r["n"] for r in df.select("i", l2_norm(l2_normalize("v")).alias("n")).collect()}
    assert all(abs(n - 1.0) < 1e-6 for i, n in out.items() if i != 999) and out[999] == 0.0
    assert math.isfinite(sum(out.values()))


TOKENS = ["final answer", "final  answer", "Final Answer", ":", " : ", ".", ",", ";", "\n", " ", "  ", "\t",
          "yes", "Yes", "no", "NO", "a", "b", "1", "0", "positive", "negative", "present", "absent", "seen",
          "shows", "without", "normal", "not present", "no evidence", "unremarkable", "eyes", "nodule",
          "consistent with", "suggests", "**", "maybe", "x", "answer", "final"]

texts = st.lists(st.sampled_from(TOKENS), min_size=0, max_size=12).map("".join)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=300, max_size=300))
def test_parser_forms_agree_on_generated_text(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, raw string")
    staged = {r["i"]: (r["v"]["verdict"], r["v"]["stage"]) for r in with_verdict(df, "raw").collect()}
    single = {r["i"]: (r["v"]["verdict"], r["v"]["stage"]) for r in df.select("i", parse_verdict("raw").alias("v")).collect()}
    rows = spark.createDataFrame([(0, list(enumerate(batch)))], "item int, answers array<struct<k:int, raw:string>>")
    array = {a["k"]: (a["pred"], a["stage"]) for a in with_verdict_array(rows, "answers").first()["answers"]}
    assert staged == single == array


def test_normalise_cost_is_linear_in_the_width(spark):
    import time

    def seconds(d):
        df = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda x: x.cast("double")).alias("v"))
        df = df.select(l2_normalize("v").alias("n"))
        df.write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t
    assert seconds(2048) < 8 * max(seconds(512), 0.1)
