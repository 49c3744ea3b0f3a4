"""Word splitting and shingles on whole and sliced Arrow arrays."""

import time

import pyarrow as pa
import pytest

from lodestone.llm import common


def plain(codes, dictionary, starts):
    words = [dictionary[c].as_py() for c in codes]
    return [words[a:b] for a, b in zip(starts[:-1], starts[1:])]


TEXTS = [" A b\tc ", None, "", "Éa éB\x0b\x0cx", "one", " not space"]


@pytest.mark.parametrize("cut", [0, 1, 3])
def test_words_of_slices(cut):
    found = plain(*common.encode_words(pa.array(TEXTS).slice(cut)))
    assert found == [["a", "b", "c"], [], [], ["Éa", "éb", "x"], ["one"], [" not space"]][cut:]


def test_slices_cover_a_batch_and_keep_texts():
    batch = pa.record_batch({"i": pa.array(range(6)), "t": pa.array(TEXTS)})
    parts = list(common.sliced([batch], 1))
    small = list(common.slices(batch, 1, 4))
    assert [t for p in parts for t in p.column(1).to_pylist()] == TEXTS == [t for p in small for t in p.column(1).to_pylist()]
    assert len(small) > 2
    whole = [s.tolist() for s in common.shingle_sets(batch.column(1), 2)]
    assert [s.tolist() for p in small for s in common.shingle_sets(p.column(1), 2)] == whole


def test_shingles_are_sets_of_words_in_order():
    sets = common.shingle_sets(pa.array(["a b a b a b", "A B", "b a", "a", "", None, "a b c", "c b a"]), 3)
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 1, 1]
    assert sets[1].tolist() != sets[2].tolist() and sets[6].tolist() != sets[7].tolist()


def test_scratch_tables_are_in_the_shared_folder(spark):
    scratch = common.Scratch(spark, "t")
    made = scratch.table(spark.range(3), "x")
    assert made.count() == 3 and scratch.base.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.drop(made)


def test_small_tables_need_no_python_workers(spark):
    rows = [(1, None, [1, 2], 0.5), (None, "x", None, None)]
    schema = "a int, b string, c array<long>, d double"
    found = common.small_table(spark, rows, schema)
    assert [tuple(r) for r in found.collect()] == rows and found.schema == spark.createDataFrame([], schema).schema
    assert "LocalTableScan" in found._jdf.queryExecution().toString()
    assert common.small_table(spark, [], schema).count() == 0 and common.small_table(spark, [], schema).schema == found.schema


def test_scratch_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    counts = spark.range(50_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    kept = common.Scratch(spark, "test").table(counts, "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and kept.count() == 100 and counts.count() == 100
    assert spark.conf.get(common.CLEANUP, None) == setting
