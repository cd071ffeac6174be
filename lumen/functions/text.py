"""Text projections: stripping, report assembly, prompts, chat messages, cleaning.

All functions return ``Column`` expressions so they stay inside whole-stage
codegen; nothing here calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's ``str.strip()`` removes every character for which ``isspace()`` is
# true: Unicode White_Space plus the four separators U+001C..U+001F. Java's
# ``(?U)\s`` covers the former, so the class adds the latter.
WS = r"[\s\x{1c}-\x{1f}]"
_STRIP_RE = rf"(?U)\A{WS}+|{WS}+\z"

# Fixed values that must equal the reference's prompts and defaults.
DEFAULT_INDICATION = "Chest x-ray"
REPORT_PROMPT = "{indication} findings:"
CLASSIFY_PROMPT = (
    "Is there {condition} in this image? You may write out your argument before stating "
    "your final very short, definitive, and concise answer (if possible, a single word or "
    "the letter corresponding to your answer choice) X in the format 'Final Answer: X':"
)
SYSTEM_PROMPT = "You are a helpful medical assistant."
IMAGE_TOKEN = "<start_of_image>"
# Markdown headers a generator may prepend; removed case-sensitively.
GENERATED_HEADERS = ("Findings", "Impression", "Report")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def normalize_text(df: DataFrame, cols) -> DataFrame:
    """Absent column -> "", null -> "", cast to string, strip."""
    present = set(df.columns)
    for name in cols:
        if name in present:
            df = df.withColumn(name, py_strip(F.coalesce(F.col(name).cast("string"), F.lit(""))))
        else:
            df = df.withColumn(name, F.lit(""))
    return df


def full_report(findings, impression) -> Column:
    """``findings + " " + impression`` stripped (inputs already non-null)."""
    return py_strip(F.concat(_col(findings), F.lit(" "), _col(impression)))


def prompt_from_indication(indication) -> Column:
    """Blank indication -> default; template ``"{indication} findings:"``."""
    ind = py_strip(F.coalesce(_col(indication).cast("string"), F.lit("")))
    ind = F.when(ind == "", F.lit(DEFAULT_INDICATION)).otherwise(ind)
    head, tail = REPORT_PROMPT.split("{indication}")
    return F.concat(F.lit(head), ind, F.lit(tail))


def prompt_for_condition(condition) -> Column:
    """T4: classification prompt with the lower-cased condition name."""
    head, tail = CLASSIFY_PROMPT.split("{condition}")
    return F.concat(F.lit(head), F.lower(_col(condition)), F.lit(tail))


def _part(kind: str, text: Column | None = None) -> Column:
    txt = text if text is not None else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), txt.alias("text"))


def chat_messages(prompt, with_system: bool = True) -> Column:
    """T4a chat shape: ``array<struct<role, content: array<struct<type, text>>>>``.

    The user turn holds an ``image`` part (its pixels travel as a separate
    binary column) followed by the prompt text. Report generation adds a
    system turn; classification (``with_system=False``) sends the user turn only.
    """
    user = F.struct(F.lit("user").alias("role"),
                    F.array(_part("image"), _part("text", _col(prompt))).alias("content"))
    if not with_system:
        return F.array(user)
    system = F.struct(F.lit("system").alias("role"),
                      F.array(_part("text", F.lit(SYSTEM_PROMPT))).alias("content"))
    return F.array(system, user)


def plain_prompt(prompt) -> Column:
    """T4a plain shape for non-chat checkpoints: image token, newline, prompt, stripped."""
    return py_strip(F.concat(F.lit(IMAGE_TOKEN + "\n"), _col(prompt)))


def prompt_payload(prompt, model_id, plain_models=()) -> Column:
    """Pick the shape per row; ``plain_models`` lists the non-chat model ids."""
    chat = F.to_json(chat_messages(prompt, with_system=True))
    if not plain_models:
        return chat
    return F.when(_col(model_id).isin(list(plain_models)), plain_prompt(prompt)).otherwise(chat)


def clean_generated(c) -> Column:
    """Null -> "", drop ``**Findings:**``-style headers and trailing space, strip."""
    alts = "|".join(GENERATED_HEADERS)
    body = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")),
                            rf"(?U)\*\*({alts}):\*\*{WS}*", "")
    return py_strip(body)


def clean_reference(c) -> Column:
    """Null -> "", strip."""
    return py_strip(F.coalesce(_col(c).cast("string"), F.lit("")))
