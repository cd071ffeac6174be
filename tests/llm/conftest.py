import os
import sys

import pytest

from .texts import DOCS, EDGE_TEXTS

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from lumen.session import build_session
    s = build_session("local[4]", app="lumen-llm-tests", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def texts(spark, sf01):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture()
def edge(spark):
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id"), (4, "one two three"), (4, "one two three")]
    from pyspark.sql import functions as F
    return (spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
            .withColumn("rep", F.lit(2)).withColumn("_w", F.lit(3)))


@pytest.fixture(scope="module")
def scratch_dir(tmp_path_factory):
    return str(tmp_path_factory.mktemp("llm"))
