"""Staged tables."""

import os

import pytest

from graphloom.plans import staging


def test_staged_tables_go_when_told(spark):
    df = staging.stage(spark.range(5))
    path = df._staged_path
    assert df.count() == 5 and os.path.isdir(path)
    staging.unstage(df, spark.range(1))
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
