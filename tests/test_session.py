import os

import pytest

from mnemos import session as S


def test_scopes_delete_what_was_cut(spark):
    kept = S.cut(spark.range(3))
    with S.scratch(spark):
        inner = S.cut(spark.range(5))
        path = inner.inputFiles()[0].removeprefix("file:")
        while path.startswith("//"):
            path = path[1:]
        assert inner.count() == 5 and os.path.exists(path)
        with S.scratch(spark):
            S.cut(spark.range(1))
    assert not os.path.exists(path) and kept.count() == 3
    S.drop_cut(spark, kept)


def test_small_tables_come_through_the_driver(spark):
    df = spark.createDataFrame([(1, [1.5], None)], "a smallint, b array<double>, c timestamp")
    assert S.gathered(df).collect() == df.collect() and S.gathered(df).schema == df.schema
    assert S.gathered(spark.range(10), 9) is None and S.kept(spark.range(10)).count() == 10 and S.gathered(df.limit(0)).isEmpty()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        S.shared_dir(Session())
