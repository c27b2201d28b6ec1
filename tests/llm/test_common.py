from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from strandlab.llm import common


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_dir(session(master))
        assert common.scratch_dir(session(master, "s3://b/x/")) == "s3://b/x"
    assert common.scratch_dir(session("local[4]")).startswith("file:///")


def test_tables_of_the_scratch_folder(spark):
    df = common.stage(spark.range(100).repartition(3, "id"), "numbers")
    assert df.count() == 100 and [f.name for f in df.schema] == ["id"]
    place = Path(df.strandlab_folder.removeprefix("file://").removeprefix("file:"))
    assert place.exists()
    common.discard(df)
    assert not place.exists()


def test_small_tables(spark):
    rows = [(1, "it's a \\ b"), (None, None), (-7, "")]
    assert [tuple(r) for r in common.small_table(spark, rows, "k bigint, v string").collect()] == rows
    empty = common.small_table(spark, [], "k bigint, v string")
    assert empty.collect() == [] and empty.dtypes == [("k", "bigint"), ("v", "string")]
    assert "RDD" not in common.small_table(spark, rows, "k bigint, v string")._jdf.queryExecution().toString()
