"""Intermediate tables: where they are, when they go, and sizes that don't depend on how a table was made."""

import random
import types

import pytest
from pyspark.sql import functions as F

from citadine.llm import near, scratch, suffixes


def test_a_cluster_needs_a_shared_folder():
    conf = lambda **own: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, default=None: own.get(k.replace(".", "_"), default)))
    assert scratch.folder(conf(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y" and scratch.folder(conf(spark_master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", ""):
        with pytest.raises(ValueError):
            scratch.folder(conf(spark_master=master))


def exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_tables_of_a_scope_go_with_it(spark):
    with scratch.scope() as made:
        one, two = scratch.table(spark.range(5), "one"), scratch.table(spark.range(7), "two")
        paths = [x._scratch[0] for x in (one, two)]
        assert one.count() == 5 and all(exists(spark, p) for p in paths)
        made.remove(two)
    assert [exists(spark, p) for p in paths] == [False, True] and two.count() == 7
    scratch.drop(two, two)
    assert not exists(spark, paths[1])


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The same rows from files, from Python, and from a join whose size the optimizer can only guess."""
    rng = random.Random(16)
    prose = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 90))) for _ in range(40)]
    made = spark.createDataFrame([(k, prose[k % 40] + (f" end{k}" if k % 3 else "")) for k in range(120)], "doc_id long, text string")
    path = f"file://{tmp_path_factory.mktemp('rows')}/documents.parquet"
    made.write.parquet(path)
    filed = spark.read.parquet(path)
    joined = filed.join(filed.select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other")).drop("other")
    return filed, made, joined


def test_sizes_and_results_of_equal_inputs_are_equal(inputs):
    assert len({scratch.text_bytes(df) for df in inputs}) == 1
    for op, own in ((near.op6, inputs[1:]), (suffixes.op10, inputs)):
        assert len({tuple(sorted(map(str, op(df).collect()))) for df in own}) == 1
