"""Tables between steps: where they go, and how small inputs are dealt out."""

from types import SimpleNamespace

import pytest

from ferrule import storage


def test_a_cluster_names_its_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    session = lambda master, **conf: SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))
    assert storage.shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://n/x/"})) == "hdfs://n/x"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))
    one = session("local[4]")
    assert storage.shared_dir(one) == storage.shared_dir(one) and storage.shared_dir(one).startswith("file:")


def test_written_tables(spark):
    rows = storage.materialise(spark.range(5), "some")
    folder = rows.inputFiles()[0].rpartition("/")[0]
    assert rows.count() == 5 and storage.names_in(spark, folder)
    storage.discard(rows)
    assert storage.names_in(spark, folder) == []


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(1_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    small = storage.spread(spark.read.parquet(str(tmp_path / "t")))
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and small.count() == 1_000
