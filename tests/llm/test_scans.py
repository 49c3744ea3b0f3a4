"""Secret scans, license scans, fingerprints, packing, mixing and archives against plain Python on small tables."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, licences, mixing, packing, secret_scan, warc

EDGES = [(1, None), (2, ""), (3, "word"), (None, "word"), (3, "word"), (4, "x " * 40000)]


def docs(spark, rows):
    """Documents with columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "s" if i is None or i % 2 else None, "b", 1) for i, t in rows], "doc_id long, text string, source string, blob string, rank int")


# --- secrets


SECRETS = [
    (10, 'token = "abcdef123" and PASSWORD:xyz API_KEY=short secret=token=abcdefgh'),
    (11, "token=token: abcdefghij"),
    (12, "é AKIA" + "A" * 16 + " AKIASHORT " + "0123456789abcdef01234567 -----BEGIN RSA PRIVATE KEY-----"),
    (13, "passwd'='0123456789abcdef0123456789"),
]


def spans(text):
    rules = [(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    found = [(m.start(), i, m.end()) for i, (p, g, n) in enumerate(rules) for m in re.finditer(p, text or "") if len(m.group(g)) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[i]}:{a}:{b}" for a, i, b in sorted(found))


def test_secret_spans_equal_plain_python(spark):
    rows = SECRETS + EDGES
    found = secret_scan.findings(docs(spark, rows).select("doc_id", "text"), secret_scan.Ledger(spark))
    base = secret_scan.joined(F.filter("spans", lambda x: x["kind"] < 3))
    got = sorted((r.doc_id or 0, r.s) for r in found.select("doc_id", base.alias("s")).collect())
    assert got == sorted((i or 0, spans(t)) for i, t in rows)


def test_ledger_scans_unseen_pairs_only(spark):
    ledger = secret_scan.Ledger(spark)
    first = docs(spark, SECRETS[:2] * 3).select("doc_id", "text")
    secret_scan.findings(first, ledger)
    assert ledger.read().count() == 2
    both = docs(spark, SECRETS).select("doc_id", "text")
    assert secret_scan.findings(both, ledger).count() == 4
    assert ledger.read().count() == 4
    ledger.scan_unseen(secret_scan.content_address(both).select("blob", "text"), "other")
    assert ledger.read().count() == 8


def test_redaction_keeps_clean_rows(spark):
    rows = [*SECRETS, *EDGES]
    out = secret_scan.redact_secrets(spark, docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    found = {r.doc_id: r.text for r in out.collect()}
    assert found[1] is None and found[3] == "word"
    assert found[10] == "[SECRET]\" and PASSWORD:xyz API_KEY=short [SECRET]"
    assert found[13] == "[SECRET]"
    assert secret_scan.redact_secrets(spark, docs(spark, rows).limit(0)).count() == 0


KEY = ["MIIEpAIBAAKCAQEA7bq3+/" + c * 42 for c in "abcdefgh"] + ["Qx7/zz=="]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def test_no_part_of_a_private_key_survives(spark):
    whole = "\n".join([BEGIN, *KEY, END])
    headers = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011AABB", ""]
    rows = {
        1: ("before\n" + whole + "\nafter", "before\n[SECRET]\nafter"),
        2: (whole.replace("\n", "\r\n"), "[SECRET]"),
        3: ("a " + "\n".join([BEGIN, *headers, *KEY, END]) + " b", "a [SECRET] b"),
        4: ('{"k": "' + whole.replace("\n", "\\n") + '\\n"}', '{"k": "[SECRET]\\n"}'),
        5: ("\n".join([BEGIN, *KEY]), "[SECRET]"),
        6: ("\n".join([BEGIN, *headers, *KEY, "", "plain words follow"]), "[SECRET]\n\nplain words follow"),
        7: (f"{whole}\nbetween\n{whole}\nend", "[SECRET]\nbetween\n[SECRET]\nend"),
        8: ("\n".join([BEGIN, *KEY, "-----BEGIN CERTIFICATE-----", "kept", "-----END CERTIFICATE-----"]), "[SECRET]\n-----BEGIN CERTIFICATE-----\nkept\n-----END CERTIFICATE-----"),
        9: ("\n".join([BEGIN, *KEY * 200, END]), "[SECRET]"),
        10: (f"a line such as {BEGIN} opens a key", "a line such as [SECRET] opens a key"),
    }
    out = secret_scan.redact_secrets(spark, docs(spark, [(i, t) for i, (t, _) in rows.items()]))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: want for i, (_, want) in rows.items()}
    assert not any(line in t for t in got.values() for line in KEY)


def test_long_texts_need_no_stack_and_no_square(spark):
    """MB-long texts that repeat what the rules repeat."""
    n = 200_000
    rows = [
        (1, "-----BEGIN " + "ABC " * n), (2, BEGIN + "\nDEK-Info: x" * n), (3, BEGIN + "\n" + ("A" * 64 + "\n") * 20_000), (4, "token=" + "ab." * n), (5, "AKIA" * n), (6, "eyJ" + "a" * n + ".eyJ" + "b" * n),
        (7, "-----BEGIN RSA " * n), (8, "token=abcdef \U0001f600 " * 30_000), (9, '"\':= ' * n), (10, BEGIN + ("-" * 5 + "x") * n),
    ]
    frame = docs(spark, rows)
    found = secret_scan.findings(frame.select("doc_id", "text"), secret_scan.Ledger(spark))
    base = secret_scan.joined(F.filter("spans", lambda x: x["kind"] < 3))
    got = {r.doc_id: r.s for r in found.select("doc_id", base.alias("s")).collect()}
    for i, t in rows:
        want = spans(t)
        assert got[i] == want, i
    out = {r.doc_id: r.text for r in secret_scan.redact_secrets(spark, frame).collect()}
    assert out[8] == "[SECRET] \U0001f600 " * 30_000 and out[4] == "[SECRET]" and out[7] == rows[6][1]


def test_redaction_merges_spans_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "CHARACTERS", 7)
    monkeypatch.setattr(secret_scan, "BLOCK", 2)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["token=abcdef01", "x", "é\U0001f600", "0123456789abcdef0123456789", "secret: token=abcdefgh", "AKIA" + "B" * 20, "pw"]) for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    out = {r.doc_id: r.text for r in secret_scan.redact_secrets(spark, docs(spark, rows)).collect()}
    for i, t in rows:
        at, want = 0, ""
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans(t).split(",") if x):
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert out[i] == want + t[at:]


def test_redaction_keeps_clashing_columns_and_large_findings(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_FINDINGS", 0)
    rows = [(i, t, "kept", "too") for i, t in [*SECRETS, (20, None), (21, "clean"), (21, "clean")]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _blob string, _spans string")
    out = secret_scan.redact_secrets(spark, frame)
    assert out.columns == frame.columns and sorted(r._blob + r._spans for r in out.collect()) == ["kepttoo"] * 7
    assert {r.doc_id: r.text for r in out.collect()}[13] == "[SECRET]"


# --- licences


def plain_licences(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    words, places, base = split(lower), [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found = {label for line in lower.split("\n") for label, t in licences.TEMPLATES if len(set(licences.words_of(t)) & set(split(line))) >= math.ceil(0.9 * len(set(licences.words_of(t))) - 1e-9)}
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(found)


def test_license_scan_equals_plain_python(spark):
    rows = [
        *EDGES, (20, "CC BY cc  by, CC-BY all rights\nreserved. General Public License"), (21, "Released under the MIT License.\nmit the under"), (22, "license License released the MIT under " * 3),
        (23, "Licensed under the Apache License, Version 2.0\nÜber cc by"), (24, "This program is free software you can redistribute it and or modify it under the terms of the gnu general public license"), (25, "by cc by cc"),
    ]
    found = licences.scan(docs(spark, rows))
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, sorted(r.base), sorted(set(r.found))) for r in found.collect())
    assert repr(got) == repr(sorted(((i or 0, *plain_licences(t)) for i, t in rows), key=lambda r: (r[0], r[1])))
    assert licences.scan(docs(spark, rows).limit(0)).count() == 0


def test_notices_do_not_depend_on_line_ends(spark):
    mit, bsd = (next(t for k, t in licences.TEMPLATES if k == label and len(t) > 100) for label in ("mit", "bsd"))
    wrapped = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    far = " ".join(w + " x" * 200 for w in bsd.split())
    filler = " ".join(f"f{i}" for i in range(3000))
    rows = [(1, "Copyright\n\n" + wrapped(mit, 6) + "\n(the"), (2, "# " + wrapped(bsd, 8).replace("\n", "\n# ")), (3, far), (4, f"{filler} {mit} {filler}"), (5, wrapped(bsd, 1))]
    got = {r.doc_id: sorted(set(r.found)) for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {1: ["mit"], 2: ["bsd"], 3: [], 4: ["mit"], 5: ["bsd"]}


# --- fingerprints


def test_edited_texts_and_likeness(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(rng.randrange(0, 300)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "é" * 50), (1003, rows[5][1]), (1004, rows[5][1])]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (x.split() for x in (t, edited, after))]
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            true = len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0
            assert abs(got[i][name] - true) < 0.25
    assert got[1003].fingerprint == got[1004].fingerprint and got[1003].near_next == 1
    edge = docs(spark, EDGES)
    assert fingerprints.edited_fingerprints(edge).count() == len(EDGES)
    assert fingerprints.edited_fingerprints(edge.limit(0)).count() == 0


@pytest.mark.parametrize("white", [" ", "\n \t", "\x0b", "\x1c ", "\xa0 "])
def test_end_of_an_edited_text_holds_its_other_shingles(white):
    """Only the end of an edited text is split into words; what comes before is the text's own."""
    import pyarrow as pa

    from lodestone.llm.common import rolled_words, shingle_sets, shingles_of

    rng = random.Random(6)
    text = lambda n: white * rng.randrange(2) + white.join("".join(rng.choice("abé日") for _ in range(rng.randrange(1, 9))) for _ in range(n)) + white * rng.randrange(2)
    for n in (0, 1, 4, 5, 6, 7, 8, 9, 30, 200):
        own, following = text(n), text(rng.randrange(0, 60))
        cut = len(own) - len(own) // 4
        whole, end, size = fingerprints.edited_end(own, following, 5)
        assert whole.decode() == own[:cut] + following[: len(own) // 4] and whole.endswith(end)
        named, codes, starts, rolled = rolled_words(pa.array([own]), 5)
        before, after = (shingles_of(*x, 5)[0].tolist() for x in ((named, codes, starts, rolled), rolled_words(pa.array([end.decode()]), 5)))
        kept = before[: int(starts[1]) - size] if size else []
        assert {*kept, *after} == set(shingle_sets(pa.array([whole.decode()]), 5)[0].tolist())
        assert n < 30 or len(after) < len(before) / 2


def test_fingerprints_equal_plain_minhash(spark):
    import xxhash

    text = "One two three four five six seven six seven eight nine ten eleven"
    mask = (1 << 64) - 1

    def mix64(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    words = [xxhash.xxh3_64_intdigest(w.encode()) for w in text.lower().split()]
    shingles = set()
    for i in range(len(words) - 4):
        h = 0
        for j in range(5):
            h = (h * 0x9E3779B97F4A7C15 + mix64((words[i + j] + j) & mask)) & mask
        shingles.add(mix64(h))
    seeds = [mix64(i * 0x9E3779B97F4A7C15 & mask) for i in range(1, 257)]
    minima = [min((s * (seeds[p] | 1) + seeds[128 + p] & mask) >> 32 for s in shingles) for p in range(128)]
    got = fingerprints.fingerprints(docs(spark, [(1, text)])).first().fingerprint
    assert got == "".join(f"{m:08x}" for m in minima)


def test_near_copies_are_verified(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:295], "x"])), (3, " ".join(base[:150] + ["y"] * 150)), (4, " ".join(base))]
    found = {(r.a, r.b) for r in fingerprints.near_copies(docs(spark, rows)).collect()}
    assert found == {(1, 2), (1, 4)}


def test_near_copies_behind_a_smaller_unlike_id_share_a_class(spark, tmp_path):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(280)]
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    tail = own(38)
    # 1 to 30 share the passage with 40 and 41, are below 0.8 to all, and head every band; 40 and 41 are near copies
    rows = [(i, " ".join(common + own(38))) for i in range(1, 31)] + [(40, " ".join(common + tail)), (41, " ".join(common + tail[:8] + own(30)))]
    rows += [(50, ""), (51, None), (None, " ".join(common + tail))]
    assert {(r.a, r.b) for r in fingerprints.near_copies(docs(spark, rows)).collect()} == {(40, 41)}
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.class_id) for r in fingerprints.op6_document_fingerprints(spark, str(tmp_path)).collect())
    assert got == [(0, None), *((i, i) for i in range(1, 31)), (40, 40), (41, 40), (50, 50), (51, 51)]


# --- packing


def test_pieces_are_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [*EDGES, *((100 + i, " ".join(rng.choice(["alpha", "beta,", "ga\nmma", "δέλτα", " two  blanks", "<|endoftext|>", "\t tab"]) for _ in range(rng.randrange(0, 900)))) for i in range(40))]
    got = packing.packed_pieces(docs(spark, rows)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for i, t in rows for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]] for cuts in [[0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]] for a, b in zip(cuts, cuts[1:]))
    assert sorted(r.ids_crc32 for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by_sequence) <= math.ceil(sum(r.length for r in got) / 1024) + 2
    whole = packing.sequences(docs(spark, rows[:8])).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.packed_pieces(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.randrange(1, 60)):
        s = rng.randrange(1, 100)
        counts[s] = counts.get(s, 0) + rng.randrange(1, 9)
    done = packing.complete_bins(counts, 100)
    used = {}
    for p in done:
        assert sum(p.lengths) <= 100
        for s in p.lengths:
            used[s] = used.get(s, 0) + p.times
    assert used == counts
    assert sum(p.times for p in done) <= sum(p.times for p in packing.best_fit(counts, 100))


def fewest_bins(items, capacity):
    """By trying every place for every item."""
    best, items = len(items), sorted(items, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_bin_completion_equals_brute_force():
    for seed in range(120):
        rng = random.Random(seed)
        items = [rng.randrange(5, 70) for _ in range(rng.randrange(1, 10))]
        counts = {x: items.count(x) for x in items}
        want = fewest_bins(items, 100)
        assert sum(p.times for p in packing.complete_bins(counts, 100)) == want >= packing.lower_bound(counts, 100)


def test_a_piece_in_place_of_several_dominates():
    assert packing.dominated([20, 10], {20: 1, 10: 1, 30: 1}, 0) and packing.dominated([20], {20: 1, 22: 1}, 3)
    assert not packing.dominated([20, 10], {20: 1, 10: 1, 31: 1}, 0) and not packing.dominated([30], {30: 2, 20: 1, 10: 1}, 0)


def test_dominated_against_all_sums():
    rng = np.random.default_rng(5)
    for _ in range(500):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 60, 12), rng.integers(0, 3, 12))}
        some = [s for s, n in counts.items() for _ in range(n)]
        fill, waste = [int(s) for s in rng.permutation(some)[: rng.integers(1, 5)]], int(rng.integers(0, 6))
        sums = [(sum(c), k) for k in range(1, len(fill) + 1) for c in itertools.combinations(fill, k)]
        expected = any(counts.get(t, 0) > fill.count(t) and (k > 1 or t > total) for total, k in sums for t in range(total, total + waste + 1))
        assert packing.dominated(fill, counts, waste) == expected


def test_dominated_takes_no_walk_over_sums():
    """The driver's search calls it some thousand times: 300 fillings of small pieces with much waste within 3 seconds."""
    fill, counts = [1] * 400 + [2] * 200, {1: 400, 2: 200}
    began = time.process_time()
    assert not any(packing.dominated(fill, counts, 900 + i % 2) for i in range(300))
    assert time.process_time() - began < 3


def test_bin_completion_finds_a_perfect_packing():
    counts = {60: 1, 50: 2, 40: 1, 30: 2, 20: 2}  # best fit alone needs a fourth bin
    assert sum(p.times for p in packing.complete_bins({k: v for k, v in counts.items()}, 100)) == 3


# --- mixing


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 80))), rng.choice(["a", "a", "a", "b", None, "c"])) for i in range(400)] + [(None, "x y", "a"), (7, None, "b"), (8, "w w", "b"), (8, "w w", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("s", F.lit(1)).withColumn("start", F.lit(2))
    placed, slots, pieces = mixing.mix(frame, block=16)
    got = mixing.taken(placed, pieces).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == sizes[s] and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= 1
    again = mixing.taken(*(mixing.mix(frame.repartition(3), block=16)[i] for i in (0, 2))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(frame.limit(0))[0].count() == 0
    # the schedule is spread evenly: a source's slots stray little from its share at every point
    for (s,), n in {(r.s,): 0 for r in slots.collect()}.items():
        own = sorted(r.slot for r in slots.collect() if r.s == s)
        share = len(own) / (max(r.slot for r in slots.collect()) + 1)
        assert all(abs(k - share * slot) < 12 for k, slot in enumerate(own))


def test_schedule_equals_plain_python(spark):
    sources = [(0, "a", 1000, 700.0), (1, "b", 37, 60.0), (2, "c", 5, 0.0), (3, "d", 1, 2.0), (4, None, 90, 180.0)]
    block, golden = 16, 679535556991
    need = [(s, size, -(-size // block), (int(t) // size) * -(-size // block) + -(-(int(t) % size) // block), int(t)) for s, _, size, t in sources if t]
    total, at, cuts = sum(n[3] for n in need), 0, []
    for n in need:
        cuts.append((n[0], (at << 40) // total, ((at + n[3]) << 40) // total))
        at += n[3]
    own = {n[0]: [] for n in need}
    free = []
    for slot in range(total):
        u = slot * golden % (1 << 40)
        s = next(s for s, low, high in cuts if low <= u < high)
        if len(own[s]) < next(n[3] for n in need if n[0] == s):
            own[s].append(slot)
        else:
            free.append(slot)
    for s, *_, slots, _ in need:
        while len(own[s]) < slots:
            own[s].append(free.pop(0))
    want = set()
    for s, size, blocks, _, words in need:
        for rank, slot in enumerate(own[s]):
            b = rank % blocks
            want.add((s, rank, slot, b, min(block, size - b * block, words - rank // blocks * size - b * block)))
    got = {tuple(r) for r in mixing.schedule(spark, sources, block).select("s", "rank", "slot", "block", "words").collect()}
    assert got == want and sorted(x[2] for x in got) == list(range(total))
    high = (1 << 39) + 12345
    assert spark.range(1).select(mixing.golden_point(str(high) + "L").alias("u")).first().u == high * golden % (1 << 40)


def test_mix_keeps_clashing_columns_and_rows_that_share_an_id(spark):
    rows = [(1, "w " * 50, "a", "x", "y", "z"), (1, "v", "b", "x", "y", "z"), (None, "u u", "a", "x", "y", "z"), (None, "t t t", None, "x", "y", "z"), (2, "", "a", "x", "y", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _times string, _copy string")
    out = mixing.mix_documents(spark, frame)
    assert out.columns == frame.columns
    kept = out.collect()
    assert {r._id + r._times + r._copy for r in kept} == {"xyz"} and {r.text for r in kept} <= {r[1] for r in rows} and "" not in {r.text for r in kept}


def test_water_filling():
    assert mixing.water_fill([100, 10, 10], [5, 2, 1], 60, 2) == [pytest.approx(37.5), pytest.approx(15), pytest.approx(7.5)]
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 120, 2) == [20, pytest.approx(200 / 3), pytest.approx(100 / 3)]
    assert sum(mixing.water_fill([1, 1], [1, 1], 100, 2)) == 4


# --- archives


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_payloads_that_hold_records_come_back_whole(spark, compression):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["<p>é</p>", None, "", "same", "same", inner, inner * 3 + "tail", "WARC/1.1\r\n", "x" * 300000, "WARC/1.1\r\nContent-Length: 999999\r\n\r\n", "\r\n\r\n", inner]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nx", b, "extra") for i, b in enumerate(bodies)], "page_id long, url string, html string, digest string")
    path = warc.Scratch(spark, "t").path("archive")
    warc.write(warc.records(pages).repartition(2), path, records_per_file=4, compression=compression)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert sorted(got) == list(range(len(bodies)))
    first = {}
    for i, b in enumerate(bodies):
        b = b or ""
        origin = first.setdefault(b, i)
        assert got[i].type == ("response" if origin == i else "revisit")
        assert got[i].refers_to == (None if origin == i else origin)
        assert bytes(got[i].payload).decode() == (b if origin == i else "")
    assert warc.records(pages, least_bytes=5).where("refers_to is not null").count() == 1
    assert spark.createDataFrame([("",)], "x string").select(warc.base32_sha1(F.col("x").cast("binary"))).first()[0] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    empty = warc.Scratch(spark, "t").path("archive")
    warc.write(warc.records(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_urls_ids_and_repeated_pages(spark):
    bodies = ["hello world", "hello world", "hello world", "other", "", "hello world", "lone"]
    ids = [-7, -7, 4, None, None, None, 9]
    urls = ["http://h/\u2028Content-Length: 3", "http://h/\x85Content-Length: 3", None, "a\r\nContent-Length: 2", "", "x", "x\u2029WARC/1.1\r\n"]
    pages = spark.createDataFrame(list(zip(ids, urls, bodies)), "page_id long, url string, html string")
    path = warc.Scratch(spark, "t").path("archive")
    warc.write(warc.records(pages), path)
    got = sorted(str((r.page_id, r.type, r.refers_to, bytes(r.payload).decode(), r.payload_bytes)) for r in warc.read(spark, path).collect())
    assert got == sorted(map(str, [
        (-7, "response", None, "hello world", 11), (-7, "revisit", -7, "", 11), (4, "revisit", -7, "", 11), (None, "response", None, "other", 5),
        (None, "response", None, "", 0), (None, "revisit", -7, "", 11), (9, "response", None, "lone", 4),
    ]))
    same = spark.createDataFrame([(1, "u", "same")] * 3, "page_id long, url string, html string")
    path = warc.Scratch(spark, "t").path("archive")
    warc.write(warc.records(same), path)
    assert sorted(r.type for r in warc.read(spark, path).collect()) == ["response", "revisit", "revisit"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_survive_other_splits(spark, monkeypatch, compression):
    """Files may be cut into other splits, and dealt to other tasks, when payloads are read again."""
    rows = [(k, f"http://a/{k}", f"text {k} " * 20 + "WARC/1.1\r\nWARC-Type: no\r\nContent-Length: 3\r\n\r\nabc" * (k % 3) + f" end {k}") for k in range(400)]
    path = warc.Scratch(spark, "t").path("archive")
    warc.write(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3), path, records_per_file=50, compression=compression)
    settings = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    first = warc.reached

    def between(*args):
        for name, value in zip(settings, ["300000", "0", "1"]):
            spark.conf.set(name, value)
        return first(*args)

    monkeypatch.setattr(warc, "reached", between)
    try:
        for name, value in zip(settings, ["5000", "5000", "7"]):
            spark.conf.set(name, value)
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == {k: html for k, _, html in rows}


def test_texts_are_encoded_a_few_megabytes_at_once(monkeypatch):
    import pyarrow as pa

    text, seen = "some words of a text " * 500, []
    encode = packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: seen.append(texts.nbytes) or encode(self, texts))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(50)), "text": pa.array([text] * 50)}) for _ in range(20)]
    pieces = pa.Table.from_batches(packing.cut_texts(batches, packing.tokenizer_path(), 1024))
    assert max(seen) <= 3 << 20 and sum(seen) > 10_000_000
    assert len(set(zip(pieces["doc_id"].to_pylist(), pieces["piece"].to_pylist()))) * 20 == pieces.num_rows


def test_a_text_is_split_once_for_license_blocks(spark):
    """Filters over the split words don't repeat the splitting: once for the words held, once for the blocks of what is left."""
    rows = [(1, "Released under the MIT License.\nmit the under"), (2, None)]
    keyed = docs(spark, rows).selectExpr("doc_id", "coalesce(text, '') AS text", "0L AS text_key")
    found = licences.matching_blocks(keyed)
    assert [(r.doc_id, r.block, r.label) for r in found.collect()] == [(1, 0, "mit")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_encoded_words_are_let_go_with_the_task():
    import pyarrow as pa

    from lodestone.llm import packing

    path = packing.tokenizer_path()
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["some words of a text"])})]
    assert len(list(packing.cut_texts(batches, path, 1024))) == 1
    assert packing._encoders[path].known == {"": 0}
