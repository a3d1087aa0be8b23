import os

import pytest

from attestry import session


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError):
        session.named_folder("spark://host:7077", None)
    with pytest.raises(RuntimeError):
        session.named_folder("local-cluster[2,1,1024]", None)
    assert session.named_folder("yarn", "hdfs://x/y") == "hdfs://x/y"


def test_tables_are_released(spark):
    df = session.shared_checkpoint(spark.range(3).toDF("a"))
    assert sorted(r.a for r in df.collect()) == [0, 1, 2]
    folder = session.shared_folder(spark).removeprefix("file:")
    assert any(x.startswith("step-") for x in os.listdir(folder))
    session.release(spark)
    assert not any(x.startswith("step-") for x in os.listdir(folder))
