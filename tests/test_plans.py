"""Physical-plan checks: JVM-only hot paths, pruned scans, broadcast scoring."""

from conftest import SF01

from lumen.plans.queries import QUERIES

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def _final_plan(df):
    """AQE's final plan of this DataFrame's own execution (a write would run a
    separate execution and leave this one un-optimised)."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in text
    return text.split("== Initial Plan ==")[0]


def test_hot_paths_have_no_python(spark):
    for name in ["verdict_parse", "cls_policies", "auc_exact", "probe_score", "set_f1", "best_key_join"]:
        text = _plan(QUERIES[name](spark, SF01))
        assert not any(n in text for n in PYTHON_NODES), name


def test_scans_read_only_needed_columns(spark):
    text = _plan(QUERIES["studies_clean"](spark, SF01))
    read = [line for line in text.splitlines() if "ReadSchema" in line]
    assert read and all("text" not in line for line in read)  # the large document body is never read
    text = _plan(QUERIES["cls_policies"](spark, SF01))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in text


def test_model_scoring_broadcasts_models(spark):
    final = _final_plan(QUERIES["probe_score"](spark, SF01))
    assert "BroadcastHashJoin" in final and "CartesianProduct" not in final
    assert "BroadcastNestedLoopJoin" not in final


def test_policy_evaluation_has_one_shuffle(spark):
    final = _final_plan(QUERIES["cls_policies"](spark, SF01))
    exchanges = [ln for ln in final.splitlines() if "Exchange" in ln and "hashpartitioning" in ln]
    assert len({ln.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for ln in exchanges}) == 1
    assert all("condition_id" in ln for ln in exchanges)  # only the per-condition aggregation shuffles


def test_small_sides_become_broadcasts_only_at_run_time(spark):
    # No static broadcast from estimates; AQE converts after measuring the listing.
    df = QUERIES["file_failures"](spark, SF01)
    initial = _plan(df)
    assert "BroadcastHashJoin" not in initial
    assert "BroadcastHashJoin" in _final_plan(df)
