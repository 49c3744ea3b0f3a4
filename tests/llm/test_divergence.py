"""The source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import divergence

SCHEMA = "text string, lang string, source string, item string, rank int"


def plain(rows, least_docs, top):
    """The contract word by word, over all terms of every pair."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(lang or "", source or "", terms(text)) for text, lang, source, *_ in rows]
    seen, held, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        held[lang, source].update(words)
        sources[lang].add(source)
    found = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, names in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= least_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(held[lang, s]) for s in names}
        q = shares(sum((held[lang, s] for s in names), Counter()))
        for s in names:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in names if o != s))
            found |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            own = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if held[lang, s][t] and p[s][t] > q[t])
            found |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(own[:top], 1)}
    return found


def run(spark, rows, **options):
    got = [tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [3, 2048])
def test_divergence_equals_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    r = random.Random(5)
    words = ["Straße", "ÄÖ", "äö", "the", "THE", "x1y", "naïve", "日本", "a\0b", "é", "zebra", "_under_"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de", None, "x\0y"]), r.choice(["s1", "s2", "s3", None, "é"]), "clash", 1) for _ in range(120)]
    rows += [rows[0]] * 5 + [(None, "en", "empty", "", 0), ("", "none", "a", "", 0), (None, "none", None, "", 0), ("long " * 60000, "en", "s1", "", 0)]
    assert run(spark, rows, least_docs=4, top=3) == plain(rows, 4, 3)


def test_no_terms_and_no_rows(spark):
    assert run(spark, []) == set()
    rows = [("one two", "en", "a", "", 0), ("one", "en", "b", "", 0)]
    assert run(spark, rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_counts_beyond_longs(spark):
    """Shares of very large counts are exact."""
    row = spark.sql("SELECT 20000000000L AS c, 40000000001L AS n, 3L AS v").select(divergence.share(*(divergence.F.col(x) for x in "cnv")))
    assert row.first()[0] == 1 + 10**9 * 20000000002 // (40000000001 + 6)


def test_terms_are_summed_by_batch_and_group(spark):
    """A batch gives one row for each term of a group, not one for each of a document; counts and documents are exact."""
    rows = [("The cat THE\0x1é", "en", "a"), ("the", "en", "a"), ("the the", "en", "b"), ("", "en", "b"), ("the", "de", "a")] * 20
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    found = [tuple(r) for r in divergence.batch_counts(docs).collect()]
    assert sorted(found) == [("de", "a", "the", 20, 20), ("en", "a", "cat", 20, 20), ("en", "a", "the", 60, 40), ("en", "a", "x", 20, 20), ("en", "a", "é", 20, 20), ("en", "b", "the", 40, 20)]
