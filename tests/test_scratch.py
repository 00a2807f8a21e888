from types import SimpleNamespace

import pytest

from lodestrata.sources import scratch as sc


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sc.scratch(spark, "x")


def test_freed_folders(spark):
    made = []
    with pytest.raises(ValueError), sc.freed(spark, kept=("kept",)):
        made += [sc.scratch(spark, tag) for tag in ("kept", "gone")]
        for path in made:
            spark.range(3).write.parquet(path)
        raise ValueError
    assert spark.read.parquet(made[0]).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(made[1])
    sc.drop_scratch(spark, made[0])
