"""Scalar projections: whitespace, paths, labels, names, headers, sizes."""

from pyspark.sql import functions as F

from lumen.functions.labels import u_zero
from lumen.functions.paths import drop_two_dirs, patient_num, resolve_model_meta, short_from_patient
from lumen.functions.text import clean_generated, clean_reference, full_report, py_strip
from lumen.operators.sampling import target_sizes


def test_py_strip_matches_python(spark):
    texts = ["  a b  ", "\tx\n", " y ", " z　", "\x1cw\x1f", "", "no-space", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(py_strip("t")).collect()]
    assert got == [t.strip() for t in texts]


def test_path_keys(spark):
    paths = ["valid/patient1/study1/v.jpg", "Set-v1.0/valid/patient00012/study2/view3.jpg",
             "a/b/nothing.jpg", "patients/patient7/s/v.jpg", "patient/x", None, "x.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(patient_num("p"), short_from_patient("p"), drop_two_dirs("p")).collect()
    assert [r[0] for r in rows] == [1, 12, None, 7, None, None, None]
    assert [r[1] for r in rows] == ["patient1/study1/v.jpg", "patient00012/study2/view3.jpg", None,
                                    "patients/patient7/s/v.jpg", "patient/x", None, None]
    assert [r[2] for r in rows] == ["study1/v.jpg", "patient00012/study2/view3.jpg", "nothing.jpg",
                                    "s/v.jpg", "patient/x", None, "x.jpg"]


def test_u_zero(spark):
    vals = [None, float("nan"), -1.0, 0.0, 1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in df.select(u_zero("v")).collect()] == [0, 0, 0, 0, 1, 2]


def test_model_names(spark):
    rows = [("Pleural Effusion_64", None, None), ("edema_512", None, None), ("a_b_7", None, None),
            ("noscore", None, None), ("x_y", None, None), ("atelectasis_64", "", 128),
            ("missing_64", "missing", 64), ("trailing_", None, None)]
    df = spark.createDataFrame(rows, "n string, mc string, ms int")
    cond, size = resolve_model_meta("n", "mc", "ms")
    got = [(r[0], r[1]) for r in df.select(cond, size).collect()]
    assert got == [("Pleural Effusion", 64), ("edema", 512), ("a_b", 7), ("noscore", None), ("x", None),
                   ("atelectasis", 128), ("missing", 64), ("trailing", None)]


def test_clean_generated_and_reference(spark):
    rows = [("**Findings:** lungs clear", " ref "), ("**Impression:**\nno change **findings:** 2", None),
            (None, "\tx\n"), ("**Report:**   ok  **Findings:**x", "")]
    df = spark.createDataFrame(rows, "g string, r string")
    got = df.select(clean_generated("g"), clean_reference("r")).collect()
    assert [tuple(r) for r in got] == [("lungs clear", "ref"), ("no change **findings:** 2", ""),
                                       ("", "x"), ("ok  x", "")]
    assert df.select(full_report(F.lit(""), F.lit("b"))).first()[0] == "b"


def test_target_sizes_worked_cases(spark):
    cases = {5000: [64, 512, 4096], 7000: [64, 512, 4096, 7000], 50: [50], 512: [64, 512], 96: [64, 96]}
    df = spark.createDataFrame([(n, n) for n in cases], "g long, n long")
    out = target_sizes(df).groupBy("g").agg(F.sort_array(F.collect_list("sample_size")).alias("s")).collect()
    assert {r["g"]: list(r["s"]) for r in out} == cases
