import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import corpus_pipeline
from shardloom.llm import registry
from shardloom.llm.common import written
from twins import connect, differences


def test_stages(spark, small_dir, docs):
    at = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, counts = at.columns, []
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, small_dir), name)
        counts.append(at.count())
        assert at.columns == columns + ["token_ids"] * (name == "tokenise")
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]


def test_stages_on_nothing(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_run_twice(spark, sf_dir):
    a, b = (corpus_pipeline.run(spark, sf_dir).select("doc_id", "text").toPandas().sort_values(["doc_id", "text"]).to_numpy().tolist() for _ in range(2))
    assert a == b and a


def test_extra_columns(spark, small_dir, clashing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, small_dir)
        assert set(clashing.columns) <= set(out.columns), name
        out.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert not differences(got, connect(sf_dir).sql(registry.ORACLES[name]).df())
