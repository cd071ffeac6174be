"""The library without its optional part: a copy without the training-data folders imports and lists its queries."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

CODE = """
import __spark_entry__ as E
names = E.queries()
assert "cls_policies" in names and "probe_train" in names, sorted(names)
assert not [n for n in names if n.startswith("op") or n == "pipeline"], sorted(names)
assert set(E.oracle_sql()) <= set(names)
import lumen.plans.queries, lumen.operators.probes, lumen.streaming.incremental
"""


@pytest.mark.parametrize("without", [("lumen/llm", "corpus_pipeline.py"), ("lumen/llm",)])
def test_entry_without_the_optional_part(tmp_path, without):
    left_out = {os.path.normpath(os.path.join(ROOT, x)) for x in without}

    def skip(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(folder, n)) in left_out]

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=skip)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    got = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
