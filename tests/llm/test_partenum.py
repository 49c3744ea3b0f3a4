"""The n-gram Jaccard join against all pairs by brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import partenum


def sets_of(text, n):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, threshold):
    sets = [(i, sets_of(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and len(a & b) * threshold.denominator >= len(a | b) * threshold.numerator:
                p, q = sorted((find(sets[x][0]), find(sets[y][0])))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def family(rng, base, n, edits, words):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(own)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    common = [f"c{i}" for i in range(60)]
    texts = []
    for length, copies, edits in ((900, 8, 30), (300, 24, 10), (120, 16, 5), (15, 12, 2)):
        base = [rng.choice(words) for _ in range(length)]
        near = family(rng, base, copies, edits, words)
        texts += near + family(rng, near[1], copies // 3, edits, words)  # copies of a copy
    texts += [[*common, *(rng.choice(words) for _ in range(rng.randint(5, 30)))] for _ in range(12)]
    texts += [["a"], ["a", "b"], ["a", "b"], [], ["A", "B"]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "threshold", "several"), [(3, Fraction(9, 10), 2), (5, Fraction(4, 5), 64)])
def test_components_equal_brute_force(spark, monkeypatch, n, threshold, several):
    monkeypatch.setattr(partenum, "SEVERAL", several)
    rows = corpus(n)
    found = partenum.jaccard_components(spark.createDataFrame(rows, "id long, text string"), n, threshold)
    assert {r.id: (r.n_shingles, r.component) for r in found.collect()} == brute(rows, n, threshold)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", None), (None, "one two three four", "y"), (7, "one two three four", "y"), (7, "one two three four", "y"), (8, "long " * 30000, "z"), (9, "Long " * 30000, "z")]
    docs = spark.createDataFrame(rows, "id long, text string, component string")
    found = partenum.jaccard_components(docs, 3, Fraction(9, 10)).collect()
    assert sorted((r.id or 0, r.n_shingles, r.component) for r in found) == [(0, 2, 7), (1, 0, 1), (2, 0, 2), (3, 0, 3), (7, 2, 7), (7, 2, 7), (8, 1, 8), (9, 1, 8)]
    assert partenum.jaccard_components(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = [(4, "a b c d e f", "s"), (2, "a b c d e f", "t"), (5, "other words", None), (6, None, "u"), (None, "a b c d e f", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = partenum.keep_one_of_each_group(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5, 6]


def test_stage_decides_by_id_and_set(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, "B b b b b b"), (7, "a a2 a3 a4 a5 a6"), (7, "b b b b b b"), (9, long), (9, long), (10, long + " x"), (11, long.upper()), (12, ""), (12, ""), (None, "A a2 a3 a4 a5 a6")]
    docs = spark.createDataFrame([(*r, "m", "i") for r in rows], "doc_id long, text string, _mark string, _id string")
    kept = partenum.keep_one_of_each_group(spark, docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect())
    assert got == sorted([(3, "b b b b b b"), (7, "a a2 a3 a4 a5 a6"), (9, long), (12, ""), (12, ""), (0, "a a2 a3 a4 a5 a6")])


def test_bands_admit_every_pair_of_sizes():
    for threshold in (Fraction(9, 10), Fraction(4, 5)):
        bands = partenum.size_bands(threshold, 500)
        for a in range(1, 300):
            b = int(a / threshold)
            fitting = [2 * (n - 1) for low, high, n in bands if low <= a and b <= high]
            assert fitting and max(fitting) >= int((1 - threshold) / (1 + threshold) * (a + b))



@pytest.mark.parametrize("threshold", [Fraction(9, 10), Fraction(4, 5)])
def test_similar_sets_share_a_signature(threshold):
    rng = np.random.default_rng(5)
    signed = lambda s: set(partenum.Signer(threshold)([s])[0].tolist())
    for size in (1, 5, 10, 11, 19, 40, 90, 200, 500, 1000):
        for _ in range(20):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            most = int((1 - threshold) / (1 + threshold) * 2 * size)
            gone = int(rng.integers(0, most // 2 + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, most // 2 - gone if rng.random() < 0.5 else gone, dtype=np.uint64)])
            shared = len(np.intersect1d(a, b))
            if len(b) and shared * threshold.denominator >= (len(a) + len(b) - shared) * threshold.numerator:
                assert not most or set(a.tolist()) == set(b.tolist()) or signed(np.unique(a)) & signed(np.unique(b))


def test_frequent_phrases_are_no_signatures(spark, tmp_path):
    """Texts that share frequent phrases alone don't meet: their rare shingles come first in the order."""
    from lodestone.llm.common import Scratch

    rng = random.Random(11)
    phrases = [" ".join(f"c{rng.randrange(40)}" for _ in range(12)) for _ in range(12)]
    own = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(12))
    rows = [(i, 0, " ".join(x for p in rng.sample(phrases, 6) for x in (p, own()))) for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, mark long, text string")
    scratch = Scratch(spark, "test")
    order = partenum.sampled_order(scratch, docs, 3)
    marked = scratch.table(partenum.marked_sets(docs, 3, Fraction(9, 10), order), "marked")
    assert marked.where("size(sigs) > 0").count() == 600
    assert partenum.buckets(scratch, marked).count() == 0


def test_order_loses_no_pair(spark, monkeypatch):
    """Whatever the sample says of words and shingles, pairs above the threshold meet."""
    monkeypatch.setattr(partenum, "MOST_LISTED", 60)
    monkeypatch.setattr(partenum, "SAMPLE", 20)
    rows = corpus(8)
    found = partenum.jaccard_components(spark.createDataFrame(rows, "id long, text string"), 3, Fraction(9, 10))
    assert {r.id: (r.n_shingles, r.component) for r in found.collect()} == brute(rows, 3, Fraction(9, 10))


def test_stage_leaves_little_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.llm.common.shared_folder", lambda s: str(tmp_path))
    rows = [(i, " ".join(f"w{(i % 20) * 1000 + j}" for j in range(200))) for i in range(60)]
    assert partenum.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string")).count() == 20
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"gone"}


def test_centres_of_large_groups_make_no_row_per_member_and_element(spark):
    """Elements leave a part of a group only if most of its sets hold them."""
    own = lambda i: [1000 + 40 * i + j for j in range(40)]
    held = spark.createDataFrame([(7, i, 1000, [*range(20), *own(i)]) for i in range(1000)] + [(8, 1, 2, [1, 2]), (8, 2, 2, [2, 3])], "g long, a long, n long, xs array<long>")
    found = partenum.often_in_parts(held).collect()
    assert {r.d for r in found if r.g == 7} == set(range(20)) and {(r.d, r.often) for r in found if r.g == 8} == {(2, 2)}
    assert len(found) < 20 * 20 and sum(r.often for r in found if r.d == 5) == 1000


def test_sample_is_counted_whole(spark, tmp_path):
    """Words and shingles of three texts or more are listed with their counts, wherever the texts lie; the shuffle has no row for each."""
    from lodestone.llm.common import Scratch, rolled_words

    import pyarrow as pa

    rows = [(i, f"a b c d x{i} y{i} z{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(7)
    order = partenum.sampled_order(Scratch(spark, "test"), docs, 3)
    named, codes, _, rolled = rolled_words(pa.array(["a b c d"]), 3)
    assert set(order.words[0].tolist()) == set(named.tolist()) and set(order.common[0].tolist()) == set(rolled.tolist())
    assert set(order.words[1].tolist()) == {int(4 * np.log2(40)) // 2} and set(order.common[1].tolist()) == {128 + int(4 * np.log2(40))}


def test_signatures_of_overlapping_bands_are_made_once():
    """A set in two bands has the signatures of the longer beginning; how many of them a band takes is beside them."""
    for threshold, size in ((Fraction(4, 5), 180), (Fraction(9, 10), 350)):
        sign = partenum.Signer(threshold)
        found, lengths = sign([np.arange(size, dtype=np.uint64)])[0], sign.lengths(size)
        holding = [j for j, (least, most, _) in enumerate(partenum.size_bands(threshold, 4096)) if least <= size <= most]
        assert lengths[::2] == holding and len(holding) == 2
        assert len(set(found.tolist())) == len(found) == max(lengths[1::2]) <= (1 - threshold) * size + 1


def test_members_meet_by_signature_and_band():
    keys = np.array([5, 5, 5, 5, 6, 7, 7, 7, 8, 8], np.int32)
    members = np.array([1, 2, 3, 2, 1, 4, 5, 4, 1, 2], np.int64)
    codes = np.array([3 << 8 | 1, 3 << 8 | 3, 4 << 8 | 1, 3 << 8 | 3, 3 << 8 | 3, 9 << 8 | 1, 10 << 8 | 1, 9 << 8 | 1, 3 << 8 | 1, 3 << 8 | 1], np.int32)
    g, a = partenum.by_signature(keys, members, codes, False)
    found = {}
    for x, y in zip(g.tolist(), a.tolist()):
        found.setdefault(x, set()).add(y)
    assert sorted(map(sorted, found.values())) == [[1, 2], [2, 3]] and len(g) == 4  # 5 in bands 3 and 4; 8 has the same sets as 5 in band 3
    g, a = partenum.by_signature(keys[:3], members[:3], codes[:3], True)
    assert sorted(a.tolist()) == [1, 2, 2, 3] and len(set(g.tolist())) == 2
    assert [len(x) for x in partenum.by_signature(keys[:0], members[:0], codes[:0], False)] == [0, 0]


@pytest.mark.parametrize("growth", [None, Fraction(5, 4)])
def test_rarest_elements_of_members(spark, growth):
    """Against plain Python; members' elements are no rows, in no join."""
    import math

    rng = random.Random(4)
    rows = [(g, a, 50 + a % 7 * 10, s := rng.randrange(0, 12), s + rng.randrange(0, 12), sorted(rng.sample(range(60), rng.randrange(0, 25)))) for g in (1, 2) for a in range(30)]
    found = partenum.rarest(spark.createDataFrame(rows, "g long, a long, size int, short int, long int, ds array<long>").where("size(ds) > 0"), growth)
    expected = {}
    for g, a, size, short, long, ds in rows:
        often = {d: sum(d in r[5] for r in rows if r[0] == g) for d in ds}
        for place, d in enumerate(sorted(ds, key=lambda d: (often[d], d)), 1):
            if often[d] > 1 and place <= long:
                band = math.floor(math.log(size) / (math.log(growth) * (1 + 1e-9))) if growth else 0
                for b in (band, band + 1) if growth else (0,):
                    expected.setdefault((g, d, b), set()).add((a, place <= short))
    got = {}
    for r in found.collect():
        got.setdefault(r.g, set()).add((r.a, r.short))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
