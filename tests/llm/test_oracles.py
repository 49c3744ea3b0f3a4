"""The registered queries against their SQL on the small tables, and those without SQL by what they must give."""

import duckdb
import pytest

from lodestone import llm


def plain(v):
    return "" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = llm.QUERIES[name](spark, sf_dir)
    found = c.execute(llm.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(plain(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(plain(x) for x in r) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in llm.QUERIES if n not in llm.ORACLES and n != "op11_html_extraction"])
def test_query_covers_its_table(spark, sf_dir, name):
    """Queries without SQL run as registered; what they must give is tested beside each operator."""
    found = llm.QUERIES[name](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert set(found.doc_id) == set(docs.doc_id)
    if "piece" not in found:
        assert len(found) == len(docs)
    if "score" in found:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
        both = found[found.held_out].merge(labels, on="doc_id")
        truth = both["toxic" if "toxicity" in name else "quality"]
        assert found.score.between(0, 1).all() and (both.predicted == truth).mean() > 0.85
    if "taken" in found:
        by = found.groupby(found.source_size).agg(taken=("taken", "sum"), target=("target", "first"))
        assert (abs(by.taken - by.target) < 2).all() and (found.taken <= 2 * found["size"]).all()
    if "sequence_id" in found:
        assert (found.groupby("sequence_id").length.sum() <= 1024).all()
