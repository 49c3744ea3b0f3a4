"""The Merkle manifest against plain Python that builds every tree level by level."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from lodestone.llm import manifest

SCHEMA = "text string, doc_id long, leaf string, lang string, n_chars long, source string, i int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def climb(tree, i, folded, proof):
    for level in tree[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        k, i = i % 3, i // 3
        proof += run[:k] + run[k + 1 :]
        folded = H(*run[:k], folded, *run[k + 1 :])
    return folded


def plain(rows):
    by = defaultdict(list)
    for text, doc_id, _, lang, n_chars, source, _ in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        now = text.replace("\n", "") if even and text is not None else text
        by[source].append(((doc_id is not None, doc_id or 0), leaf_of(doc_id, source, lang, n_chars, text), leaf_of(doc_id, source, lang, n_chars, now), doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([leaf for _, leaf, *_ in sorted(by[s])]) for s in sources]
    top, found = levels([t[-1][0] for t in trees]), []
    for home, s in enumerate(sources):
        for i, (_, leaf, now, doc_id) in enumerate(sorted(by[s])):
            proof = []
            folded = climb(top, home, climb(trees[home], i, now, proof), proof)
            found.append((doc_id, leaf, trees[home][-1][0], top[-1][0], H(*proof), folded, folded == top[-1][0]))
    return found


def same(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op12_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows))
    return got


def test_odd_rows(spark, tmp_path):
    rows = [(None, 5, "clash", "en", None, None, 1), ("a\nb", 6, "", None, 3, "s", 1), ("a\nb", 6, "", None, 3, "s", 2), ("", None, "", "", 0, "s", 3), ("x\n", None, "", "de", 2, None, 4)]
    rows += [("é\n" * k, -k, "", "fr", k, "é" if k % 2 else "", k) for k in range(9)] + [("lone\n", 77, "", "en", 5, "one", 0), ("word \n" * 200_000, 78, "", "en", 1_200_000, "s", 0)]
    got = same(spark, tmp_path, rows)
    assert {r.verified for r in got} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    same(spark, tmp_path / "one", [("a\nb", 3, "", "en", 3, "s", 0)])
    same(spark, tmp_path / "none", [])


def test_high_trees(spark, tmp_path):
    """A source of over 27^3 leaves and over 27 sources: every sort of stored row is met."""
    r = random.Random(3)
    rows = [(r.choice(["x", "y\n", "\nz\n"]), k * 7 % 20011, "", "en", 1, "hot", 0) for k in range(20_000)]
    rows += [(r.choice(["x", "y\n"]), k, "", "en", 1, f"s{r.randint(0, 39)}", 0) for k in range(900)] + [("m\n", k, "", "en", 1, "mid", 0) for k in range(28)]
    same(spark, tmp_path, rows)
