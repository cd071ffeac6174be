"""Path keys, model-name parsing and output naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumen.functions.text import _col


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def patient_num(path) -> Column:
    """T5: first ``patient(\\d+)`` group as a number; null when absent or not numeric."""
    digits = _nonempty(F.regexp_extract(_col(path), r"patient(\d+)", 1))
    return digits.try_cast("bigint")


def short_from_patient(path) -> Column:
    """T6 (key A): from the first ``patient`` to the end; null when there is none."""
    return _nonempty(F.regexp_extract(_col(path), r"(patient.*)", 1))


def drop_two_dirs(path) -> Column:
    """T7 (key B): remove exactly the first two folders; unchanged if there are fewer."""
    return F.regexp_replace(_col(path), r"^(?:[^/]+/){2}", "")


def resolve_path(key, base_dir: str) -> Column:
    """Absolute keys stay, relative keys are joined to ``base_dir``."""
    k = _col(key)
    base = base_dir.rstrip("/")
    return F.when(k.startswith("/"), k).otherwise(F.concat(F.lit(base + "/"), k))


def model_name(condition, size) -> Column:
    """T18 build: ``"{condition}_{size}"``."""
    return F.concat(_col(condition), F.lit("_"), _col(size).cast("string"))


def size_from_name(name) -> Column:
    """T18 parse: integer after the last ``_``; null without ``_`` or when not an int."""
    n = _col(name)
    tail = F.regexp_extract(n, r"_([^_]*)$", 1)
    return F.when(n.contains("_"), F.trim(tail).try_cast("int"))


def condition_from_name(name) -> Column:
    """T18 parse: everything before the last ``_`` (whole name when there is none)."""
    return F.regexp_replace(_col(name), r"_[^_]*$", "")


def resolve_model_meta(name, meta_condition, meta_size):
    """Stored values win; an empty stored condition counts as absent, a size only when null."""
    cond = F.coalesce(_nonempty(_col(meta_condition)), condition_from_name(name))
    size = F.coalesce(_col(meta_size).cast("int"), size_from_name(name))
    return cond, size


def date_prefix(ts: Column | None = None) -> Column:
    """``MM-dd`` of the run date, used as the output-name prefix."""
    return F.date_format(ts if ts is not None else F.current_date(), "MM-dd")


def run_path(base: str, run_date: str, task: str) -> str:
    """K9: one output-path rule for every run, empty or not."""
    return f"{base.rstrip('/')}/{task}/run_date={run_date}"
