"""The verdict parser on a table of answers, in its column, staged and array forms."""

import pytest

from lumen.functions.verdict import parse_verdict, with_verdict, with_verdict_array

#: (answer, verdict, stage): 1 yes, 0 no, -1 ambiguous; the stage that decided.
CASES = [
    (None, -1, 0),
    ('', -1, 0),
    ('   ', -1, 0),
    ('\t\n', -1, 0),
    ('Yes', 1, 3),
    ('No', 0, 3),
    ('yes.', 1, 3),
    ('NO!', 0, 3),
    ('Final Answer: Yes', 1, 1),
    ('Final Answer: No', 0, 1),
    ('final answer:yes', 1, 1),
    ('FINAL ANSWER :   no', 0, 1),
    ('Final  answer : A.', 1, 1),
    ('Final Answer: B', 0, 1),
    ('Final Answer: 1', 1, 1),
    ('Final Answer: 0', 0, 1),
    ('Final Answer: positive', 1, 1),
    ('Final Answer: Absent', 0, 1),
    ('Final Answer: present.', 1, 1),
    ('Final Answer: negative; maybe', 0, 1),
    ('**Final Answer**: no', 0, 2),
    ('Final Answer:\n **Yes**', 1, 1),
    ('final answer: unclear; yes perhaps', 1, 2),
    ('final answer: unclear, no idea', 0, 2),
    ('final answer: maybe', -1, 3),
    ('The heart is large. Final Answer: Yes', 1, 1),
    ('Final Answer: normal', 0, 1),
    ('Final Answer: none', 0, 1),
    ('Final Answer: not sure', 0, 1),
    ('Lungs clear', -1, 3),
    ('Opacity is seen', 1, 3),
    ('There is no evidence of edema', 0, 3),
    ('Consistent with pneumonia', 1, 3),
    ('Findings suggest effusion', -1, 3),
    ('The image shows cardiomegaly', 1, 3),
    ('Unremarkable study', 0, 3),
    ('Without acute findings', 0, 3),
    ('Nodule present', 0, 3),
    ('Diagnosis pending', 0, 3),
    ('Unknown', 0, 3),
    ('My eyes hurt', 1, 3),
    ('Normal heart size', 0, 3),
    ('Absent', 0, 3),
    ('Negative for consolidation', 0, 3),
    ('Positive and negative', -1, 3),
    ('Present but not present', -1, 3),
    ('yes and no', 1, 3),
    ('final answer', -1, 3),
    ('final answer:', -1, 3),
    ('final answer: \xa0yes', 1, 1),
    ('Final Answer: x yes', 1, 2),
    ('Answer: yes', 1, 3),
    ('  final answer  :  Yes  ', 1, 1),
    ('Final Answer: YES!!!', 1, 1),
    ('final answer: yes\nfinal answer: no', 1, 1),
    ('final answer: maybe\nfinal answer yes', 1, 2),
    ('Probably present', 1, 3),
    ('It is seen without doubt', -1, 3),
]
PHRASES = [p for p, _, _ in CASES]
EXPECTED = [(v, s) for _, v, s in CASES]


def test_single_column(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "i int, raw string")
    got = {r["i"]: (r["v"]["verdict"], r["v"]["stage"]) for r in df.select("i", parse_verdict("raw").alias("v")).collect()}
    for i, p in enumerate(PHRASES):
        assert got[i] == EXPECTED[i], p


def test_staged_projection(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "i int, raw string")
    got = {r["i"]: (r["v"]["verdict"], r["v"]["stage"]) for r in with_verdict(df, "raw").collect()}
    for i, p in enumerate(PHRASES):
        assert got[i] == EXPECTED[i], p


def test_array_form(spark):
    rows = [(i, [(k, p) for k, p in enumerate(PHRASES[i:i + 5])]) for i in range(0, len(PHRASES), 5)]
    df = spark.createDataFrame(rows, "item int, answers array<struct<k:int, raw:string>>")
    for r in with_verdict_array(df, "answers").collect():
        for a in r["answers"]:
            assert (a["pred"], a["stage"]) == EXPECTED[r["item"] + a["k"]], PHRASES[r["item"] + a["k"]]


def test_all_verdicts_and_stages_occur():
    assert {v for v, _ in EXPECTED} == {-1, 0, 1}
    assert {s for _, s in EXPECTED} == {0, 1, 2, 3}


@pytest.mark.parametrize("text,expected", [
    ("normal", 0), ("not sure", 0), ("none", 0), ("diagnosis", 0), ("nodule", 0), ("eyes", 1),
])
def test_substring_quirks_kept(spark, text, expected):
    row = spark.createDataFrame([(text,)], "raw string").select(parse_verdict("raw").alias("v")).first()
    assert row["v"]["verdict"] == expected
