import os
from types import SimpleNamespace

import pytest

from tessella import shared


def session(master, **conf):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf={})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(ValueError):
        shared.shared_dir(session(master))
    assert shared.shared_dir(session(master, **{"spark.checkpoint.dir": "file:///x/y/"})) == "file:///x/y"


def test_names_that_no_column_has():
    assert shared.fresh(["a", "K1", "_k1"], "k1") == "__k1"
    assert shared.fresh([], "k1") == "k1"


def test_checkpoints_go_to_the_shared_folder(spark):
    from tessella.operators import graph

    edges = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert sorted(r["node"] for r in graph.reach(edges, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2]
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert os.path.basename(shared.shared_dir(spark)) in where


def test_folders_are_removed(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    shared.delete(spark, f"file://{tmp_path}/a")
    assert not (tmp_path / "a").exists()
