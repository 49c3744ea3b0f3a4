"""The pipeline's stages keep what they should, on rows of every odd sort."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice(["an", "the", "or", "in", "ti", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    rows, labels = [], []
    for i in range(300):
        body = " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(20, 250)))
        junk = i % 6 == 0
        if junk:
            body = " ".join(w + rng.choice(["&&&", "###", "|"]) for w in body.split())
        rows.append((i, body, "en", f"s{i % 3}", len(body)))
        labels.append((i, int(not junk), 0))
    rows.append((400, rows[1][1], "en", "s1", 1))
    rows.append((401, rows[2][1] + " token=abcdefgh1", "en", None, 1))
    rows.append((402, None, None, "s1", None))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
    good, single, clean, mixed, packed = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not {i for i in ids(good) if i < 300 and i % 6 == 0} and {i for i in range(300) if i % 6} <= ids(good)
    assert 400 not in ids(single) and 401 not in ids(single) and {i for i in range(300) if i % 6} <= ids(single)
    assert single.count() == clean.count() and not clean.where(F.contains("text", F.lit("abcdefgh1"))).count()
    assert ids(mixed) <= ids(clean) and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    assert ids(packed) == ids(mixed) and before == 303
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_empty_and_null_tables_pass_every_stage(spark, folder):
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_registry():
    names = [q for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
