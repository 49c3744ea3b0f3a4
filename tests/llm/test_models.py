"""The classifiers on held-out rows, and exact search against brute force."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import covertree, quality, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=900, seed=1):
    """Prose, some of it with insults (toxic) and some of it junk (of no quality)."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "or", "in", "ti", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        sentences = [[rng.choice(words) for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(3, 25))]
        if toxic:
            sentences[rng.randrange(len(sentences))].insert(2, rng.choice(["idiot", "moron", "scum"]))
        body = ". ".join(" ".join(s) for s in sentences) + "."
        if junk:
            body = " ".join(w + rng.choice(["&&&", "###", "|"]) for w in body.split())
        docs.append((i, body, "x"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, score string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), {i: (q, t) for i, q, t in labels}


ODD = [(None, "words of a row without id", "x"), (1, None, "x"), (2, "", "x"), (2, " \n ", "x"), (3, "a " * 50000, "x"), (3, "a " * 50000, "x")]


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    model = toxicity.fit(toxicity.training_rows(docs, labels, "toxic", 8000).toArrow())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(truth[i][1]) for i in got if fold(i)]
    assert sum(right) / len(right) > 0.97
    found = toxicity.offending_sentences(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start : r.end] == r.text for r in found)
    assert sum(any(w in r.text for w in ("idiot", "moron", "scum")) for r in found) / len(found) > 0.95
    odd = spark.createDataFrame(ODD, docs.schema)
    assert [0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()] == [True] * len(ODD)
    assert toxicity.score(odd.limit(0), model).count() == 0 == toxicity.offending_sentences(odd.limit(0), model).count()
    assert toxicity.training_rows(docs, labels, "toxic", 50).count() == 50


def test_toxicity_without_labels_marks_nothing(spark, tables):
    docs, labels, _ = tables
    model = toxicity.fit(toxicity.training_rows(docs, labels.where("doc_id < 0"), "toxic", 8000).toArrow())
    assert toxicity.score(docs, model).where("score >= 0.5").count() == 0


def test_training_rows_leave_the_held_out_fold_alone(tables):
    docs, labels, _ = tables
    ids = {t: i for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    assert not any(fold(ids[r.text]) for r in toxicity.training_rows(docs, labels, "toxic", 8000).collect())


def test_quality_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    right = [(got[i] >= 0.3) == bool(truth[i][0]) for i in got if fold(i)]
    assert sum(right) / len(right) > 0.97
    odd = spark.createDataFrame(ODD, docs.schema)
    scored = quality.score(odd, model)
    assert scored.columns == [*docs.columns, "quality_score"] and scored.where("quality_score between 0 and 1").count() == len(ODD)
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_stage_keeps_clashing_columns(spark, tables, tmp_path):
    docs, labels, truth = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = docs.withColumn("quality_score", F.lit("kept")).withColumn("_score", F.lit(1))
    out = quality.keep_good_documents(spark, frame, str(tmp_path))
    assert out.columns == frame.columns and out.where("quality_score != 'kept'").count() == 0 and 0 < out.count() < docs.count()


def test_sentence_spans_are_those_of_the_model():
    texts = ["One two. Three!\nFour five", "", "a\x02b \x02 c? d", "  x.\n\ny z  ", "No end"]
    words, codes, number, first = toxicity.sentence_words(pa.array(texts))
    for i, t in enumerate(texts):
        spans = toxicity.sentence_spans(t)
        assert len(spans) == first[i + 1] - first[i]
    assert [t[a:b] for t in texts[:1] for a, b in toxicity.sentence_spans(t)] == ["One two.", "Three!", "\n", "Four five"]


def test_quality_reads_no_negative_label(tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    share = sum(q for i, (q, _) in truth.items() if not fold(i)) / sum(not fold(i) for i in truth)
    assert abs(model.prior - share) < 0.05
    hidden = quality.fit(docs, labels.withColumn("quality", F.when(F.col("quality") == 1, 1)))
    assert hidden.prior == model.prior and np.allclose(hidden.layers[0][0], model.layers[0][0])
    assert quality.fit(docs, labels.where("doc_id < 0")) is None


def brute(vectors, queries, k):
    out = []
    for q, a in queries:
        best = sorted((-int(np.dot(a, b)), i) for i, b in vectors if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "alike", "few"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 100)
    monkeypatch.setattr(covertree, "GROUP_ROWS", 20)
    rng = np.random.default_rng(3)
    n = 3 if kind == "few" else 1300
    centres = rng.normal(0, 60, (8, 6))
    points = np.floor(centres[rng.integers(0, 8, n)] + rng.normal(0, 4, (n, 6)))
    if kind == "alike":
        points[: n // 2] = points[0]
    rows = [(i, p.tolist(), "v") for i, p in enumerate(points)]
    odd = [(5000, None, "v"), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0], "v"), (5002, [float("nan")] + [9.0] * 5, "v"), (None, [1e5] * 6, "v"), (5003, [1e5] * 3, "v")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, v array<double>, rank string")
    got = covertree.top_k(frame, frame.where(F.col("vec_id") % 50 == 0), 5)
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(points)), [(i, p) for i, p in enumerate(points) if i % 50 == 0], 5)


def test_pairs_of_clustered_data_grow_less_than_with_the_square(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 50)
    monkeypatch.setattr(covertree, "GROUP_ROWS", 10)
    monkeypatch.setattr(covertree, "FANOUT", 4)
    made = []
    kept = covertree.surviving_pairs
    monkeypatch.setattr(covertree, "surviving_pairs", lambda *a: made.append(kept(*a)) or made[-1])
    rng = np.random.default_rng(7)
    for n in (500, 2000):
        centres = rng.normal(0, 100, (n // 50, 4))
        points = np.floor(centres[rng.integers(0, len(centres), n)] + rng.normal(0, 1, (n, 4)))
        frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<double>")
        got = covertree.top_k(frame, frame.where("vec_id % 10 = 0"), 5)
        assert sorted(map(tuple, got.collect())) == brute(list(enumerate(points)), [(i, p) for i, p in enumerate(points) if i % 10 == 0], 5)
    few, many = (m.count() for m in made)
    assert many < 8 * few  # four times the rows: 16 times as many pairs if none were pruned


def test_search_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, v array<double>")
    assert covertree.top_k(frame, frame, 5).count() == 0


def test_trees_cover_their_points():
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (500, 3)), np.zeros((300, 3))])
    tree = covertree.CoverTree(np.arange(len(points)), points, leaf=16)
    assert sorted(tree.ids.tolist()) == list(range(len(points)))
    for centre, radius, a, b, first, end in tree.nodes:
        assert math.sqrt(((tree.points[a:b] - centre) ** 2).sum(1).max()) <= radius + 1e-9
        if first != end:
            assert (tree.nodes[first][2], tree.nodes[end - 1][3]) == (a, b)


def test_pruning_leaves_blocks_out():
    rng = np.random.default_rng(5)
    near, far = rng.normal(50, 1, (200, 4)), rng.normal(-50, 1, (200, 4))
    q = covertree.CoverTree(np.arange(1000, 1020), rng.normal(50, 1, (20, 4)))
    scores, _ = covertree.search(q, covertree.CoverTree(np.arange(200), near), np.full(20, -np.inf), 5)
    assert covertree.bound(q, 0, covertree.CoverTree(np.arange(200), far), 0) < scores[:, 4].min()


@pytest.mark.parametrize("share", [0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95])
def test_prior_whatever_the_share(share):
    draw = np.random.default_rng(5)
    good = draw.random(4000) < share
    rows = np.hstack([np.where(good[:, None], 3.0, 0.0) + draw.normal(size=(4000, 1)), draw.normal(size=(4000, 4))])
    assert abs(quality.estimated_prior(rows[good], rows) - share) < 0.05


def test_share_at_top_against_thresholds():
    draw = np.random.default_rng(6)
    p, u = np.round(draw.normal(2, 1, 300), 1), np.round(np.concatenate([draw.normal(2, 1, 200), draw.normal(0, 1, 300)]), 1)
    error = sum((np.log(40) / (2 * len(x))) ** 0.5 for x in (p, u))
    tails = [((p >= c).mean(), (u >= c).mean()) for c in sorted({*p, *u}) if (p >= c).any()]
    a, b = min(tails, key=lambda t: (t[1] + 1.01 * error) / t[0])
    assert quality.share_at_top(p, u) == pytest.approx(b / a)
    assert quality.estimated_prior(p[:1, None], p[:1, None]) == 0.5
