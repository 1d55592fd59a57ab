import os
from types import SimpleNamespace

import pytest

from glyphsift.llm import common


def fake(master, folder=None):
    context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: folder, setCheckpointDir=lambda d: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: None))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(fake(master))
    assert common.shared_dir(fake("yarn", "hdfs:/tmp")) == "hdfs:/tmp/glyphsift-app"
    assert common.shared_dir(fake("local[2]")).startswith("file://")


def test_working_tables_are_deleted(spark):
    a = common.stored(spark.range(3).toDF("x"), "a")
    path = a._glyphsift_path.removeprefix("file://")
    assert os.path.isdir(path) and a.count() == 3
    common.discard(a, spark.range(1))
    assert not os.path.exists(path)
