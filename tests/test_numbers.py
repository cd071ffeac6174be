"""Rounding as Python's round() on generated values and ties."""

import math

import numpy as np
import pytest

from lumen.functions.numbers import MAX_DIGITS, python_round

KNOWN = [2.675, 0.125, 0.375, 1.005, 2.5, 3.5, -2.675, -0.125, 0.0, 1e-300, 5e-324, 1e22, 123456789.125, 0.5, 1.5, 1e15 + 0.3,
         2.0 ** 53, 2.0 ** 60, 1.7976931348623157e308, 0.1, 0.05, 0.15, 0.25, 0.35, 1 / 3, 2.0 ** -40, 4.35, 8.5, 0.045]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4, 9])
def test_equals_python(spark, digits):
    rng = np.random.default_rng(digits)
    odd = rng.integers(0, 10**6, 400) * 2 + 1
    values = [*KNOWN, *(odd / 2 / 10**digits).tolist(), *(odd / 1024).tolist(), *rng.uniform(-1000, 1000, 400).tolist(),
              *(rng.uniform(0, 1, 200) * 10.0 ** rng.integers(-20, 20, 200)).tolist(), *(2.0 ** rng.integers(-70, 60, 50)).tolist(),
              *np.nextafter(odd[:100] / 2 / 10**digits, 0).tolist(), *np.nextafter(odd[:100] / 2 / 10**digits, 1e9).tolist()]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", python_round("x", digits).alias("r"))
    bad = [(r.x, r.r, round(r.x, digits)) for r in df.collect() if r.r != round(r.x, digits)]
    assert not bad, bad[:5]
    assert sum(1 for v in values if abs(v) < 1e9 and (v * 10**digits) % 1 == 0.5) > 300


def test_values_that_stay(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double").select(python_round("x", 2).alias("r"))
    a, b, c, d = [r.r for r in df.collect()]
    assert a is None and math.isnan(b) and c == math.inf and d == -math.inf
    with pytest.raises(ValueError):
        python_round("x", MAX_DIGITS + 1)
