import glob
from types import SimpleNamespace as Fake

import pytest

from quireline.llm import common as C
from quireline.streaming import decisions as ST


def elsewhere():
    """A frame of a session on a cluster that names no shared folder."""
    context = Fake(getConf=lambda: Fake(get=lambda key: None), master="spark://host:7077")
    return Fake(sparkSession=Fake(sparkContext=context, conf=Fake(get=lambda key, default: None)))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        C.cut(elsewhere())
    with pytest.raises(ValueError, match="checkpoint"):
        ST.run_once(elsewhere())


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", [1.5]), (None, None, None)], "x bigint, y string, z array<double>")
    got = C.cut(df)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert C.cut(df.limit(0)).count() == 0 and glob.glob(spark.conf.get("spark.checkpoint.dir") + "/quireline-*")


def test_spread_moves_only_what_is_in_too_few_pieces(spark):
    few, many = spark.range(10).repartition(1), spark.range(10).repartition(16)
    assert C.spread(many) is many
    assert C.spread(few).rdd.getNumPartitions() == C.parts_of(spark) >= 4 and C.spread(few).count() == 10
