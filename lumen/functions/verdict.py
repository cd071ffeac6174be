"""Free-text answer -> verdict (1 yes / 0 no / -1 ambiguous).

The rules stand in one place (``_steps``); an expression, projections over
columns and lambdas over an array are generated from it.

Three stages, first decisive one wins:
  1. an explicit ``final answer: X`` capture,
  2. the tail after the last literal ``final answer``,
  3. a leading yes/no, else a one-sided keyword vote.
Substring matching is deliberate (``normal`` starts with ``no``, ``eyes``
contains ``yes``) -- these quirks are the semantics being reproduced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions.text import _STRIP_RE, WS

# Fixed values that must equal the reference's parser.
FINAL_ANSWER_RE = rf"(?U)final{WS}*answer{WS}*:{WS}*([^\n\r.;,]+)"
FINAL_ANSWER_MARK = "final answer"
_PUNCTUATION_RE = r"(?U)[^a-z0-9\s\x{1c}-\x{1f}]"
ANSWER_POSITIVE = ["a", "1", "positive", "present"]
ANSWER_NEGATIVE = ["b", "0", "negative", "absent"]
POSITIVE_KEYWORDS = ["yes", "present", "positive", "consistent with", "suggests", "shows", "seen"]
NEGATIVE_KEYWORDS = ["no", "absent", "negative", "not present", "no evidence", "unremarkable", "without"]


def _sql_str(s: str) -> str:
    """Spark SQL raw string literal (no escape processing)."""
    assert "'" not in s
    return f"r'{s}'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_sql_str(_STRIP_RE)}, '')"


def _any(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _set(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _steps(x: str, of: Callable[[str], str]) -> tuple[dict[str, str], ...]:
    """The rules, once: SQL of each step's values by name; ``of(name)`` is how a step refers to a value of the step before.

    normalised text; what each rule looks at; what each stage says; the pick.
    """
    fin, tail = _sql_str(FINAL_ANSWER_RE), f"substring_index({of('t')}, '{FINAL_ANSWER_MARK}', -1)"
    captured = _strip(f"regexp_extract({of('t')}, {fin}, 1)")
    return (
        {"t": f"lower({_strip(f"coalesce(CAST({x} AS STRING), '')")})"},
        {"empty": f"{of('t')} = ''",
         "fin": f"{of('t')} RLIKE {fin}",
         "ans": _strip(f"regexp_replace({captured}, {_sql_str(_PUNCTUATION_RE)}, '')"),
         "mark": f"contains({of('t')}, '{FINAL_ANSWER_MARK}')", "tail_yes": f"contains({tail}, 'yes')", "tail_no": f"contains({tail}, 'no')",
         "yes": f"startswith({of('t')}, 'yes')", "no": f"startswith({of('t')}, 'no')",
         "pos": _any(of("t"), POSITIVE_KEYWORDS), "neg": _any(of("t"), NEGATIVE_KEYWORDS)},
        {"empty": of("empty"),
         "s1": f"CASE WHEN NOT {of('fin')} THEN NULL WHEN startswith({of('ans')}, 'yes') THEN 1 WHEN startswith({of('ans')}, 'no') THEN 0 "
               f"WHEN {of('ans')} IN ({_set(ANSWER_POSITIVE)}) THEN 1 WHEN {of('ans')} IN ({_set(ANSWER_NEGATIVE)}) THEN 0 END",
         "s2": f"CASE WHEN NOT {of('mark')} THEN NULL WHEN {of('tail_yes')} THEN 1 WHEN {of('tail_no')} THEN 0 END",
         "s3": f"CASE WHEN {of('yes')} THEN 1 WHEN {of('no')} THEN 0 WHEN {of('pos')} AND NOT {of('neg')} THEN 1 "
               f"WHEN {of('neg')} AND NOT {of('pos')} THEN 0 ELSE -1 END"},
        {"verdict": f"CAST(CASE WHEN {of('empty')} THEN -1 ELSE coalesce({of('s1')}, {of('s2')}, {of('s3')}) END AS INT)",
         "stage": f"CAST(CASE WHEN {of('empty')} THEN 0 WHEN {of('s1')} IS NOT NULL THEN 1 WHEN {of('s2')} IS NOT NULL THEN 2 ELSE 3 END AS INT)"},
    )


def parse_verdict(text: str) -> Column:
    """``struct<verdict:int, stage:int>`` of a text column (or SQL text); stage says which rule decided.

    One expression: for whole tables use ``with_verdict``, which evaluates every regex once per row.
    """
    known: dict[str, str] = {}
    for i in range(4):
        known = {k: f"({v})" for k, v in _steps(text, lambda n: known.get(n, "NULL"))[i].items()}
    return F.expr(f"named_struct('verdict', {known['verdict']}, 'stage', {known['stage']})")


def with_verdicts(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add one ``struct<verdict, stage>`` column per entry of ``texts`` (out -> text column).

    The steps are narrow projections over all answers at once, so every
    sub-expression is written once, which keeps the plan small to build and
    lets codegen evaluate each regex once per row.
    """
    keep = [f"`{c}`" for c in df.columns]
    steps = {o: _steps(x, lambda n, o=o: f"`_{o}_{n}`") for o, x in texts.items()}
    for i in range(3):
        df = df.selectExpr(*keep, *[f"{v} AS `_{o}_{n}`" for o in texts for n, v in steps[o][i].items()])
    pick = [f"named_struct({', '.join(f"'{n}', {v}" for n, v in steps[o][3].items())}) AS `{o}`" for o in texts]
    return df.selectExpr(*keep, *pick)


def with_verdict(df: DataFrame, text: str, out: str = "v") -> DataFrame:
    """Single-answer form of ``with_verdicts``."""
    return with_verdicts(df, {out: text})


def with_verdict_array(df: DataFrame, array_col: str, text_field: str = "raw",
                       out_field: str = "pred", stage_field: str = "stage") -> DataFrame:
    """Parse every answer of an ``array<struct<..., raw>>`` column in place.

    Used on the per-item layout (one row per item, one array slot per
    condition): the item stays in one row, so item-level rules (drop the
    item if any answer is ambiguous) need no shuffle. The steps run as
    ``transform`` lambdas so each sub-expression is evaluated once.
    The text field is replaced by ``out_field`` and ``stage_field``.
    """
    fields = [f.name for f in df.schema[array_col].dataType.elementType.fields if f.name != text_field]
    keep = [f"`{c}`" for c in df.columns if c != array_col]
    names = {"verdict": out_field, "stage": stage_field}
    at = f"`{array_col}`"
    for i, step in enumerate(_steps(f"a.`{text_field}`", lambda n: f"a.`_{n}`")):
        made = {names[n] if i == 3 else f"_{n}": v for n, v in step.items()}
        items = ", ".join([f"'{f}', a.`{f}`" for f in fields] + [f"'{n}', {v}" for n, v in made.items()])
        out = f"`{array_col}`" if i == 3 else f"`_step{i}`"
        df, at = df.selectExpr(*keep, f"transform({at}, a -> named_struct({items})) AS {out}"), out
    return df
