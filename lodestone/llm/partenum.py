"""N-gram Jaccard join by prefixes of ordered sets.

Sets fall into overlapping bands of sizes, so that every pair of sizes that the threshold admits has a band in common. All shingles
are put in one total order, from rare to frequent as far as a sample of the texts tells (see Order); the order decides only how many
sets meet, never what is found. Two sets of a band that reach the threshold share at least so many shingles that the first of these in
the order is among the first few of each: size less the least share, and one. A signature is the hash of one of these first
shingles and the band; sets that share one meet. What frequent words, lines or passages make common comes last in the order, so
unrelated sets rarely meet.

Sets that share a signature aren't paired with each other: each is paired with one of its bucket, the head of a star; the distinct
pairs are verified on the full sets, and links are merged into components. Where a bucket's members then still lie in several
components, small buckets (SEVERAL) have their pairs of different components tried. Larger ones are put together into clusters by the
sets they share, and taken apart around the elements that most of a cluster's sets hold (see around_centres): pairs near that centre
are settled by one more star, and the rest can only be linked if they share a rare difference from it and are of nearly the same size,
so those differences, by size, are the buckets of the next round, each with at most three quarters of the sets, until none is open.
Copies with edits of their own share no such difference, so a large group of them costs its number of edits, not its square, and no link
between different sets is lost.

Before sets are read, pairs are dropped whose sizes, or whose parities of elements in 1,024 classes, already differ by more than the
threshold allows. Keys that hold over a thousandth of a table's rows are joined in parts (see split_join).

Sets are told apart by 128 bits, and by 64 of them while links are made. Defined results: null, empty or blank text gives the empty
set, which is linked with nothing and is its own component; texts with fewer words than a shingle have their whole sequence as one
shingle; repeated rows and equal sets share a component; rows that repeat an id with different texts are each linked by their own
text; a null id keeps its row, with a null component unless its text equals that of others; very long texts are cut like others (their
sets are read one pair at a time); extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT, MIX, Scratch, distinct, documents, fresh, hot_parts, letting_go, mix64, rolled_words, sets_of, shingle_sets, sliced, split_join

#: Buckets with so many sets have their pairs of different components tried; larger ones are taken apart again.
SEVERAL = 64
#: Some so many texts, dealt by a hash, tell which words and shingles are frequent; so many of each are sent to all tasks.
SAMPLE = 32_768
MOST_LISTED = 1_000_000
#: Parts in which the sample's words and shingles are counted.
COUNTED = 256
#: Longs that hold a set's parities.
PARITY = 16
#: So many ids (8 bytes each) may be sent to every executor; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Signatures are dealt into parts of some IN_PART, from arrays of DEALT and more; a set's size lies in no more than BANDS bands.
IN_PART, DEALT, BANDS = 200_000, 1_000_000, 8
#: Set digests that a task remembers, so that equal sets it meets are signed once.
REMEMBERED = 500_000


def differences(a: int, b: int, threshold: Fraction) -> int:
    """How many elements sets of these sizes may differ in."""
    return int((1 - threshold) / (1 + threshold) * (a + b))


def size_bands(threshold: Fraction, largest: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, partitions) of each band up to the largest size."""
    growth = 1 / threshold ** (4 if threshold >= Fraction(17, 20) else 2)
    bands, least = [], 1
    while least <= largest:
        following = int(least * growth) + 1
        most = int((following - 1) / threshold)
        enough = differences(most, most, threshold) // 2 + 1
        bands.append((least, most, enough + 1 + enough // 50))
        least = following
    return bands


class Signer:
    """The signatures of sets of keys in ascending order: the first keys, as many as a partner of some band must hold one of. A band that
    holds a set's size takes the first of them, see lengths."""

    def __init__(self, threshold: Fraction):
        self.threshold, self.bands = threshold, size_bands(threshold, 4096)
        self.known: dict[int, list[int]] = {}

    def lengths(self, size: int) -> list[int]:
        """[band, number of signatures, ...] of the bands that hold a size and another near enough to it."""
        if size not in self.known:
            if self.bands[-1][0] <= size:
                self.bands = size_bands(self.threshold, 2 * size)
            t, found = self.threshold, []
            for j, (least, most, _) in enumerate(self.bands):
                if least <= size <= most and differences(size, min(most, int(size / t)), t):  # else no other set of the band is that near
                    smallest = max(least, -(-size * t.numerator // t.denominator))
                    shared = -(-(size + smallest) * t.numerator // (t.numerator + t.denominator))
                    found += [j, size - shared + 1]
            self.known[size] = found
        return self.known[size]

    def __call__(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        return [mix64(own[: max(self.lengths(len(own))[1::2], default=0)]) for own in sets]


def classes_of(hashes: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of each hash in a sorted list (hashes, classes); 0 if it isn't there."""
    listed, classes = known
    if not len(listed):
        return np.zeros(len(hashes), np.uint8)
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    return np.where(listed[at] == hashes, classes[at], 0).astype(np.uint8)


class Order:
    """A total order of shingles, about from rare to frequent. It only decides how many sets meet; any order loses no pair.

    Shingles go by how frequent their words are in a sample, those that many of its texts hold after all others, by number of texts."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray]):
        self.words, self.common = words, common
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(common[0] & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def keys(self, named: np.ndarray, codes: np.ndarray, starts: np.ndarray, rolled: np.ndarray, n: int, wanted: list[int], sets: list[np.ndarray]) -> list[np.ndarray]:
        """The wanted sets as sorted keys: a class in the upper 8 bits and 56 bits of the hash."""
        rank = np.zeros(len(rolled), np.uint8)
        single = classes_of(named, self.words)[codes] if len(codes) else np.zeros(0, np.uint8)
        for i in range(n if len(rolled) else 0):
            rank += np.minimum(single[i : len(rolled) + i], 127 // n)
        some = np.flatnonzero(self.maybe[(rolled & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        rank[some] = np.maximum(rank[some], classes_of(rolled[some], self.common))
        ordered = (rank.astype(np.uint64) << np.uint64(56)) | (rolled >> np.uint64(8))
        return [distinct(ordered[starts[i] : starts[i + 1] - n + 1]) if starts[i + 1] - starts[i] >= n else sets[i] for i in wanted]


def sampled_order(scratch: Scratch, docs: DataFrame, words: int) -> Order:
    """The order of the shingles of documents (id, text), from some SAMPLE of them."""
    each = max(1, docs.count() // SAMPLE)

    def run(batches):
        for batch in sliced(batches, 0):
            parts = rolled_words(batch.column(0), words)
            sets = sets_of(*parts, words)
            shingle, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            for kind, hashes, counts in ((0, parts[0], np.bincount(parts[1], minlength=len(parts[0]))), (1, shingle, often)):
                part = (hashes % np.uint64(COUNTED)).astype(np.int64)
                by_part, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=COUNTED))
                at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                xs = pa.ListArray.from_arrays(at, pa.array(hashes[by_part].view(np.int64)))
                ns = pa.ListArray.from_arrays(at, pa.array(counts[by_part].astype(np.int32)))
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(COUNTED, kind, np.int32)), "part": pa.array(np.arange(COUNTED, dtype=np.int32)), "xs": xs, "ns": ns})

    def count(key, rows):
        xs, ns = (np.asarray(rows[c].combine_chunks().flatten()) for c in ("xs", "ns"))
        place = np.argsort(xs)
        xs, ns = xs[place], ns[place].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]])) if len(xs) else np.zeros(0, np.int64)
        sums = np.add.reduceat(ns, first) if len(xs) else ns
        kept = sums >= 3
        return pa.table({"kind": pa.array(np.full(int(kept.sum()), key[0].as_py(), np.int32)), "x": pa.array(xs[first][kept]), "n": pa.array(sums[kept])})

    # most shingles are in one text: rows of their own would fill the executors' hash tables and twice the disk
    dealt = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(each)) == 0).select("text").mapInArrow(run, "kind int, part int, xs array<long>, ns array<int>")
    found = scratch.table(dealt.groupBy("kind", "part").applyInArrow(count, "kind int, x long, n long"), "common")
    del dealt
    scratch.release()  # the shuffle is larger than what it finds
    held = {0: [], 1: []}
    for r in found.groupBy("kind", F.floor(4 * F.log2("n")).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():
        held[r.kind].append((r["class"], r.n))
    listed = []
    for kind, most in ((0, 31), (1, 255)):
        least, total = 1 << 20, 0
        for at, n in held[kind]:
            total += n
            if total > MOST_LISTED:
                break
            least = at
        rows = found.where((F.col("kind") == kind) & (F.floor(4 * F.log2("n")) >= least)).select("x", F.floor(4 * F.log2("n")).alias("class")).toArrow()
        x, at = np.asarray(rows["x"]).view(np.uint64), np.asarray(rows["class"])
        place = np.argsort(x)
        listed.append((x[place], np.minimum(at // 2 if kind == 0 else 128 + at, most).astype(np.uint8)[place]))
    scratch.drop(found)
    return Order(*listed)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).astype(np.uint64, copy=False)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def summaries(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """n_shingles, high and low (128 bits that stand for the set) and bits (its parities)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        high, low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x), dtype=np.uint64)])[ends] for x in (flat + MIX, flat ^ MIX))
        high, low = mix64(np.diff(high) + sizes.astype(np.uint64)), mix64(np.diff(low))
    bits, width = [], 64 * PARITY
    for a in range(0, len(sets), 512):
        b = min(len(sets), a + 512)
        place = np.repeat(np.arange(b - a, dtype=np.int64) * width, sizes[a:b]) + (flat[ends[a] : ends[b]] % np.uint64(width)).astype(np.int64)
        odd = (np.bincount(place, minlength=(b - a) * width) & 1).astype(np.uint8)
        bits.append(np.packbits(odd).view(np.int64))
    flat_bits = np.concatenate([*bits, np.zeros(0, np.int64)])
    at = np.arange(len(sets) + 1, dtype=np.int32) * PARITY
    return {"n_shingles": pa.array(sizes), "high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64)), "bits": pa.ListArray.from_arrays(pa.array(at), pa.array(flat_bits))}


def marked_sets(docs: DataFrame, words: int, threshold: Fraction, order: Order) -> DataFrame:
    """(id, mark, n_shingles, high, low, bits, sigs, bands) of documents (id, mark, text): one pass over the texts. `bands` are a signed
    set's Signer.lengths.

    Of equal sets that a task meets the first has signatures."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        sign, seen = Signer(threshold), set()
        for batch in sliced(batches, 2):
            parts = rolled_words(batch.column(2), words)
            sets = sets_of(*parts, words)
            out = summaries(sets)
            new, named = [], np.asarray(batch.column(0).is_valid().cast(pa.uint8()), bool)
            for i, key in enumerate(out["high"].to_pylist()):
                if len(sets[i]) and named[i] and key not in seen:
                    seen.add(key)
                    new.append(i)
            signed, bands = [np.zeros(0, np.uint64)] * len(sets), [[]] * len(sets)
            for i, s in zip(new, sign(sent.value.keys(*parts, words, new, sets))):
                signed[i], bands[i] = s, sign.lengths(len(sets[i]))
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "mark": batch.column(1), **out, "sigs": lists(signed), "bands": pa.array(bands, pa.list_(pa.int32()))})

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, n_shingles long, high long, low long, bits array<long>, sigs array<long>, bands array<int>")


def set_arrays(docs: DataFrame, words: int) -> DataFrame:
    """(id, high, items): each set as a sorted array of hashes."""

    def run(batches):
        for batch in sliced(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "high": summaries(sets)["high"], "items": lists(sets)})

    return docs.select("id", "text").mapInArrow(run, "id long, high long, items array<long>")


def by_many(deal, column: str):
    """For mapInArrow: gives `deal` tables of DEALT elements and more in a column of arrays, so that what is dealt into parts are few rows."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(column).flatten())
            if size >= DEALT:
                yield deal(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
        if held:
            yield deal(pa.Table.from_batches(held).combine_chunks())

    return run


def dealt_out(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(part, arrays of what each column has of it)."""
    order = np.argsort(part, kind="stable")
    there, starts = np.unique(part[order], return_index=True)
    at = pa.array(np.concatenate([starts, [len(order)]]).astype(np.int32))
    return pa.RecordBatch.from_pydict({"part": pa.array(there, pa.int32()), **{c: pa.ListArray.from_arrays(at, pa.array(x[order])) for c, x in columns.items()}})


def flat(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [np.asarray(rows[c].combine_chunks().flatten()) for c in columns]


def by_signature(keys: np.ndarray, members: np.ndarray, codes: np.ndarray, hot: bool) -> tuple[np.ndarray, np.ndarray]:
    """(g, a) of the sets (members) that share a signature (keys) and a band with others, all those of hot signatures. A code has a band in
    its upper bits and in the lower 8 which bands from there on."""
    if not hot:
        place = np.argsort(keys, kind="stable")
        keys, members, codes = keys[place], members[place], codes[place]
        same = keys[1:] == keys[:-1]
        kept = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(keys) else place
        keys, members, codes = keys[kept], members[kept], codes[kept]
    several = [np.flatnonzero(codes >> k & 1) for k in range(BANDS)]
    within = np.concatenate([keys[at].astype(np.uint32).astype(np.uint64) << np.uint64(32) | ((codes[at] >> BANDS) + k).astype(np.uint64) for k, at in enumerate(several)])
    members = members[np.concatenate(several)]
    if hot:
        return mix64(within), members
    place = np.lexsort((members, within))
    within, members = within[place], members[place]
    new = np.concatenate([[True], within[1:] != within[:-1]])[: len(within)]
    other = np.flatnonzero(new | np.concatenate([[True], members[1:] != members[:-1]])[: len(within)])  # a set may be signed by several tasks
    new, members = new[other], members[other]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [len(new)]]))
    if not len(starts):
        return within, members
    with np.errstate(over="ignore"):
        held = np.bitwise_xor.reduceat(mix64(members.view(np.uint64)), starts)
        ends = [mix64(members[at].view(np.uint64) + np.uint64(k)) for k, at in ((1, starts), (2, starts + sizes - 1))]
        groups = mix64(held + ends[0] * MIX + mix64(ends[1] + sizes.astype(np.uint64)))
    first = np.zeros(len(groups), bool)
    first[np.unique(groups, return_index=True)[1]] = True
    kept = np.repeat(first & (sizes > 1), sizes)
    return np.repeat(groups, sizes)[kept], members[kept]


def buckets(scratch: Scratch, marked: DataFrame) -> DataFrame:
    """(g, a): the sets that share a signature and a band with others. Buckets with the same sets are one: g is a hash of what they hold.

    Signatures are dealt into parts as arrays, 32 bits of each, and put together there in numpy: most are one set's alone. Two that are
    equal in these bits make a bucket of sets that needn't have links. Signatures that hold over 1 / 100,000 of all, as a sample shows, are
    sent to all tasks and dealt by their sets, so their buckets aren't put together in one."""
    spark = marked.sparkSession
    total = marked.agg(F.sum(F.size("sigs"))).first()[0] or 0
    sample = marked.where(F.pmod(F.xxhash64("high"), F.lit(16)) == 0).select(F.explode("sigs").alias("sig"))
    often = sample.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > max(16, total // 100_000)).select("sig").toArrow()
    sent = spark.sparkContext.broadcast(np.sort(np.asarray(often["sig"]).view(np.uint64)))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // IN_PART))

    def deal(rows: pa.Table):
        hot = sent.value
        high, sigs, bands = (rows[c].chunk(0) for c in ("high", "sigs", "bands"))
        sizes = np.diff(np.asarray(sigs.offsets))
        keys, owner = np.asarray(sigs.flatten()).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        each, pairs = np.diff(np.asarray(bands.offsets)) // 2, np.asarray(bands.flatten()).reshape(-1, 2)
        at = np.cumsum(each) - each
        code = np.repeat(pairs[at, 0] << BANDS, sizes)
        for k in range(int(each.max(initial=0))):
            band, length = pairs[np.minimum(at + k, len(pairs) - 1)].T
            code |= (place < np.repeat(np.where(k < each, length, 0), sizes)).astype(np.int32) << np.repeat(np.where(k < each, band - pairs[at, 0], 0), sizes).astype(np.int32)
        members = np.asarray(high)[owner]
        part = (keys % np.uint64(parts)).astype(np.int32)
        if len(hot):
            found = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
            part = np.where(found, parts + (mix64(members.view(np.uint64)) % np.uint64(parts)).astype(np.int32), part)
        short = (keys // np.uint64(parts)).astype(np.uint32).view(np.int32)
        return dealt_out(part, {"keys": short, "members": members, "codes": code.astype(np.int32)})

    def put_together(key, rows):
        groups, members = by_signature(*flat(rows, "keys", "members", "codes"), key[0].as_py() >= parts)
        return pa.table({"g": pa.array(groups.view(np.int64)), "a": pa.array(members)})

    dealt = marked.where("size(bands) > 0").select("high", "sigs", "bands").mapInArrow(by_many(deal, "sigs"), "part int, keys array<int>, members array<long>, codes array<int>")
    return scratch.table(dealt.groupBy("part").applyInArrow(put_together, "g long, a long").distinct(), "members")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component): least id reachable over links (a, b), for ids that have links. Alternating large and small stars, until every
    id is a centre or hangs on one alone."""
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"), F.count("*").alias("n")), "least")
        unsettled, total, largest = least.agg(F.count_if((F.col("m") < F.col("u")) & ((F.col("far") > F.col("u")) | (F.col("n") > 1))), F.sum("n"), F.max("n")).first()
        if not unsettled:
            break
        parts = hot_parts(least, ["u"]) if largest > max(HOT, total // HOT) else None
        # larger neighbours go to the least of u and its neighbours; then u and its smaller ones to the least of those
        nearest = least.select("u", F.least("m", "u").alias("m"))
        large = split_join(both.where("v > u"), nearest, ["u"], parts).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, ["u"], parts).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.table(small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "stars")
        scratch.drop(edges)
        scratch.drop(least)
        edges = stars
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def with_sets(pairs: DataFrame, sets: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a written table, with the sets of both, xs and ys. `parts` are the hot keys b."""
    ys, xs = (sets.select(F.col("key").alias(k), F.col("items").alias(f"{v}s")) for k, v in ("by", "ax"))
    if pairs.count() <= MOST_BROADCAST:  # only sets of these pairs are shuffled
        sent = F.broadcast(pairs.select("a", "b"))
        return ys.join(sent, "b").join(xs.join(F.broadcast(pairs.select("a")), "a", "left_semi"), "a")
    return split_join(pairs, ys, ["b"], parts).join(xs, "a")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction, parts: DataFrame | None = None) -> DataFrame:
    """(a, b) of the pairs whose sets reach the threshold, in whole numbers."""
    both = with_sets(pairs, sets, parts).withColumn("shared", F.size(F.array_intersect("xs", "ys")).cast("long"))
    union = F.size("xs") + F.size("ys") - F.col("shared")
    return both.where(F.col("shared") * threshold.denominator >= union * threshold.numerator).select("a", "b")


def counted(rows: DataFrame, *on: str) -> DataFrame:
    return rows.groupBy(*on).agg(F.count("*").alias("n"))


class Linker:
    """Verifies pairs of sets (a, b), merges components over their links, and keeps what has been tried. A set goes by its key."""

    def __init__(self, scratch: Scratch, docs: DataFrame, summary: DataFrame, words: int, threshold: Fraction):
        self.scratch, self.docs, self.words, self.threshold = scratch, docs, words, threshold
        self.summary = summary  # (key, id, n_shingles, bits) of the sets that share signatures
        self.tried = self.sets = self.labels = self.links = None
        self.merges = 0

    def placed(self, members: DataFrame, *keys: str) -> DataFrame:
        """Adds c_<key>, the present component of each named key column."""
        for i in keys:
            if self.labels is None:
                members = members.withColumn(f"c_{i}", F.col(i))
            else:
                found = self.labels.select(F.col("id").alias(i), F.col("component").alias(f"c_{i}"))
                members = members.join(found, i, "left").withColumn(f"c_{i}", F.coalesce(f"c_{i}", i))
        return members

    def load(self, keys: DataFrame) -> None:
        """Makes the sets of (key) available."""
        if self.sets is not None:
            keys = keys.join(self.sets.select("key"), "key", "left_anti")
        keys = self.scratch.table(keys.join(self.summary.select("key", "id"), "key"), "involved")
        n = keys.count()
        if not n:
            return
        sent = F.broadcast(keys) if n <= MOST_BROADCAST else keys
        found = set_arrays(self.docs.join(sent.select("id"), "id", "left_semi"), self.words)
        # an id may have several texts
        found = found.join(sent.select("id", F.col("key").alias("high")), ["id", "high"], "left_semi").select(F.col("high").alias("key"), "items")
        more = self.scratch.table(found, "sets")
        if more.count() > n:  # rows are repeated
            more = self.scratch.table(more.dropDuplicates(["key"]), "sets")
        self.sets = more if self.sets is None else self.sets.union(more)

    def similar_sizes(self) -> Column:
        return F.least("n_a", "n_b") * self.threshold.denominator >= F.greatest("n_a", "n_b") * self.threshold.numerator

    def near_enough(self, pairs: DataFrame, parts: DataFrame | None) -> DataFrame:
        """The pairs whose sizes and parities don't rule them out."""
        side = lambda k: self.summary.select(F.col("key").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
        both = split_join(pairs, side("b"), ["b"], parts).join(side("a"), "a")
        t = self.threshold
        apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        return both.where(self.similar_sizes() & (apart * (t.denominator + t.numerator) <= (F.col("n_a") + F.col("n_b")) * (t.denominator - t.numerator))).select("a", "b")

    def verify(self, pairs: DataFrame) -> None:
        """Tries the pairs (a, b) that haven't been tried and lie in two components, and merges components over the links."""
        both_ways = (F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        pairs = self.placed(pairs, "a", "b").where("c_a != c_b").select("a", "b", *both_ways)
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["low", "high"], "left_anti")
        pairs = self.scratch.table(pairs.select("a", "b"), "pairs")
        n = pairs.count()
        if not n:
            return
        tried = pairs.select(*both_ways)
        self.tried = tried if self.tried is None else self.tried.union(tried)
        parts = hot_parts(counted(pairs, "b"), ["b"]) if n > HOT else None
        near = self.scratch.table(self.near_enough(pairs, parts), "near")
        if near.isEmpty():
            return
        self.load(near.select(F.col("a").alias("key")).union(near.select("b")).distinct())
        links = self.scratch.table(verified(near, self.sets, self.threshold, parts), "links")
        if not links.isEmpty():
            self.merge(links)

    def merge(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.union(links)
        between = self.placed(links, "a", "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        found = components(self.scratch, between)
        self.merges += 1
        if self.labels is not None:
            old = self.labels.withColumnRenamed("component", "old")
            moved = split_join(old, found.select(F.col("id").alias("old"), "component"), ["old"], hot_parts(counted(old, "old"), ["old"]), "left")
            moved = moved.select("id", F.coalesce("component", "old").alias("component"))
            found = moved.union(found.join(self.labels.select("id"), "id", "left_anti").select("id", "component"))
        self.labels = self.scratch.table(found, "labels")


def stars_of(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(a, h): pairs of each group's head and its other members (g, a). The head is the member of most groups: among copies of one text
    that is the text itself, or what is nearest to it. `parts` are the hot groups."""
    degree = members.groupBy("a").agg(F.count("*").alias("degree"))
    heads = members.join(degree, "a").groupBy("g").agg(F.max_by("a", F.struct("degree", F.col("a"))).alias("h"))
    return split_join(members, heads, ["g"], parts).where("a != h").select("a", "h").distinct()


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of pairs, b being what many share."""
    return pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def still_open(linker: Linker, members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(g, a, short, c_a, n): groups whose members lie in several components, and their sizes. Of groups with the same members one
    stays."""
    rest = linker.scratch.table(linker.placed(members, "a"), "rest")
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "short")).alias("x"), F.sum(F.xxhash64("a") % (1 << 30)).alias("y")]
    several = rest.groupBy("g").agg(F.min("c_a").alias("low"), F.max("c_a").alias("high"), F.max("short").alias("some"), *same).where("low < high and some")
    several = several.groupBy("n", "x", "y").agg(F.min("g").alias("g"))
    return split_join(rest, several.select("g", "n"), ["g"], parts).select("g", "a", "short", "c_a", "n")


def clusters(scratch: Scratch, large: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(g, a): groups (g, a) that share members put together; each set is then in one."""
    first = large.groupBy("g").agg(F.min("a").alias("b"))
    edges = split_join(large.select("g", "a"), first, ["g"], parts).select("a", "b")
    return components(scratch, edges).select(F.col("component").alias("g"), F.col("id").alias("a"))


def often_in_parts(held: DataFrame) -> DataFrame:
    """(g, d, often): elements that most of some part of a group's sets (g, a, n, xs), n in all, hold, and how many of the part do. Parts
    have about SEVERAL sets each, so what leaves them is a set's elements per part, not per set."""
    part = F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.floor(F.col("n") / SEVERAL))).alias("part")

    def most(key, rows):
        elements, often = np.unique(np.asarray(rows["xs"].combine_chunks().flatten()), return_counts=True)
        kept = 2 * often > rows.num_rows
        return pa.table({"g": pa.array(np.full(int(kept.sum()), key[0].as_py(), np.int64)), "d": pa.array(elements[kept]), "often": pa.array(often[kept].astype(np.int64))})

    return held.select("g", part, "xs").groupBy("g", "part").applyInArrow(most, "g long, d long, often long")


def around_centres(linker: Linker, named: DataFrame, by_size: bool) -> DataFrame:
    """Settles the pairs of large groups (g, a), a written table, that lie near the group's centre, and gives the groups (g, a, short)
    in which all other links of theirs are found.

    The centre is a set of elements that most members hold, as found in parts (see often_in_parts): an element counts in the parts that
    mostly hold it, so one that is missed is held by three quarters at most. D(x) is where a member x differs from the centre; what
    follows holds for any centre. With c = (1 - t) / (1 + t) at
    threshold t and excess e(x) = |D(x)| - c |x|, x and y are linked exactly if e(x) + e(y) <= 2 |D(x) and D(y)|. If that holds
    without a shared element, both are linked to the member m of least excess, so a star around m settles it. Else, with e(y) the
    lesser, the shared part is at least e(y), and at least (e(x) + e(m)) / 2: so the rarest elements of D(x) and D(y), short of these
    counts less one, hold a shared element. Edits of a copy's own are the rarest and are shared with nobody."""
    scratch, threshold = linker.scratch, linker.threshold
    unit = threshold.numerator + threshold.denominator
    linker.load(named.select(F.col("a").alias("key")).distinct())
    sizes = scratch.table(counted(named, "g"), "sizes")
    parts = hot_parts(sizes, ["g"])
    sets = linker.sets.select(F.col("key").alias("a"), F.col("items").alias("xs"))
    if sizes.agg(F.sum("n")).first()[0] <= MOST_BROADCAST:
        sets = sets.join(F.broadcast(named.select("a")), "a", "left_semi")
    held = scratch.table(split_join(named, sizes, ["g"], parts).join(sets, "a"), "held")
    common = often_in_parts(held).groupBy("g", "d").agg(F.sum("often").alias("often")).join(sizes, "g").where("2 * often > n")
    centres = common.groupBy("g").agg(F.collect_list("d").alias("centre"))  # at most two sets' elements
    apart = split_join(held, centres, ["g"], parts, "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    apart = apart.select("g", "a", F.size("xs").alias("size"), F.array_union(F.array_except("xs", "centre"), F.array_except("centre", "xs")).alias("ds"))
    excess = F.size("ds").cast("long") * unit - F.col("size") * (threshold.denominator - threshold.numerator)
    apart = scratch.table(apart.select("g", "a", "size", "ds", excess.alias("e")), "apart")
    scratch.drop(held)
    least = apart.groupBy("g").agg(F.min("e").alias("least"), F.min_by("a", F.struct("e", "a")).alias("m"))
    around = scratch.table(split_join(apart, least, ["g"], parts), "around")
    scratch.drop(apart)
    linker.verify(ordered(around.where("a != m and e + least <= 0"), "a", "m"))

    short = F.size("ds") - F.greatest(F.lit(1), F.ceil(F.col("e") / unit)) + 1
    long = F.size("ds") - F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("least")) / (2 * unit))) + 1
    limits = around.select("g", "a", F.col("size").cast("int"), short.cast("int").alias("short"), long.cast("int").alias("long"), "ds").where("size(ds) > 0")
    return rarest(limits, 1 / threshold if by_size else None)


def rarest(limits: DataFrame, growth: Fraction | None) -> DataFrame:
    """(g, a, short) of members (g, a, size, short, long, ds) of groups: g stands for a group and an element that a member and another one
    hold. Of a member's elements, in order from rare to frequent in its group, the first `long` count, and are marked if among the first
    `short`. With `growth` g has a band of sizes too: sizes no further apart than that lie in one band or in two that follow each other.

    Members' elements are dealt into parts as arrays to be counted, and those that several hold back to their members, so there is no
    row for each."""
    spark = limits.sparkSession
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(limits.agg(F.sum(F.size("ds"))).first()[0] or 0) // IN_PART))
    part_of = lambda g, x: (mix64(mix64(g.view(np.uint64)) ^ x.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    ahead = ["alone", "size", "short", "long"]
    kinds = {"g": "long", "a": "long", "d": "long"} | dict.fromkeys(["often", *ahead], "int")
    arrays = lambda *names: ", ".join(["part int", *(f"{n} array<{kinds[n]}>" for n in names)])

    def by_element(rows: pa.Table):
        at = np.asarray(rows["ds"].chunk(0).offsets)
        sizes = np.diff(at)
        found = {n: np.repeat(np.asarray(rows[n]), sizes) for n in ("g", "a", "size", "short", "long")}
        found |= {"alone": np.repeat(sizes, sizes), "d": np.asarray(rows["ds"].chunk(0).flatten())}
        return dealt_out(part_of(found["g"], found["d"]), found)

    def count(key, rows):
        found = dict(zip(("g", "a", "d", *ahead), flat(rows, "g", "a", "d", *ahead)))
        place = np.lexsort((found["d"], found["g"]))
        g, d = found["g"][place], found["d"][place]
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(g)]]))
        kept = np.repeat(sizes > 1, sizes)
        found = {n: x[place][kept] for n, x in found.items()} | {"often": np.repeat(sizes, sizes)[kept].astype(np.int32)}
        return pa.Table.from_batches([dealt_out(part_of(found["g"], found["a"]), found)])

    def choose(key, rows):
        g, a, d, often, alone, size, short, long = flat(rows, "g", "a", "d", "often", *ahead)
        order = np.lexsort((d, often, a, g))
        g, a, d, alone, size, short, long = (x[order] for x in (g, a, d, alone, size, short, long))
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1])]))
        shared = np.diff(np.concatenate([starts, [len(g)]]))
        # an element that one member alone has is shared with nobody, but it takes its place in the order, ahead of all others
        place = np.arange(len(g)) - np.repeat(starts, shared) + alone - np.repeat(shared, shared) + 1
        kept = place <= long
        g, a, d, size, short = g[kept], a[kept], d[kept], size[kept], (place <= short)[kept]
        with np.errstate(over="ignore"):
            group = mix64(mix64(g.view(np.uint64)) + d.view(np.uint64) * MIX)
            if growth is not None:
                band = np.floor(np.log(size) / (math.log(growth) * (1 + 1e-9))).astype(np.int64)  # a hair wider, for rounding
                group = np.concatenate([mix64(group + (band + k).astype(np.uint64) * MIX) for k in (0, 1)])
                a, short = np.concatenate([a, a]), np.concatenate([short, short])
        return pa.table({"g": pa.array(group.view(np.int64)), "a": pa.array(a), "short": pa.array(short)})

    counted_ = limits.mapInArrow(by_many(by_element, "ds"), arrays("g", "a", "size", "short", "long", "alone", "d")).groupBy("part")
    counted_ = counted_.applyInArrow(count, arrays("g", "a", "d", *ahead, "often"))
    return counted_.groupBy("part").applyInArrow(choose, "g long, a long, short boolean")


def link_all(linker: Linker, members: DataFrame) -> None:
    """Finds the components of all links between sets that have a group (g, a) in common, a written table."""
    scratch, level = linker.scratch, 0
    members = members.select("g", "a", F.lit(True).alias("short"))
    while True:
        level += 1
        parts = hot_parts(counted(members, "g"), ["g"])
        stars = scratch.table(stars_of(members, parts), "stars")
        if level == 1:  # most groups are one component after this
            popular = scratch.table(counted(stars, "h"), "popular")
            known = split_join(stars, popular, ["h"], hot_parts(popular, ["h"]))
            linker.verify(known.groupBy("a").agg(F.max_by("h", F.struct("n", "h")).alias("b")))
        linker.verify(ordered(stars, "a", "h"))
        open_ = scratch.table(still_open(linker, members, parts), "open")
        merges, large = linker.merges, open_.where(F.col("n") > SEVERAL)
        few = open_.where((F.col("n") <= SEVERAL) & (F.col("n") > (2 if level == 1 else 1)))  # of two a star has tried all, if both are short
        few = few.join(linker.summary.select(F.col("key").alias("a"), F.col("n_shingles").alias("n_a")), "a")
        other = few.select("g", F.col("a").alias("b"), F.col("c_a").alias("c_b"), F.col("short").alias("s_b"), F.col("n_a").alias("n_b"))
        near = linker.similar_sizes() & F.expr("a < b and c_a != c_b and (short or s_b)")
        linker.verify(few.join(other, "g").where(near).select("a", "b").distinct())
        if large.isEmpty():
            return
        large = large.select("g", "a", "short")
        if linker.merges > merges:
            large = scratch.table(still_open(linker, large, parts).select("g", "a", "short"), "large")
            if large.isEmpty():
                return
        # once only: differences from a centre are other groups than signatures make
        named = scratch.table(clusters(scratch, large, parts) if level == 1 else large.select("g", "a").distinct(), "named")
        members = scratch.table(around_centres(linker, named, level == 1), "members")
        scratch.release()


def joined_groups(scratch: Scratch, docs: DataFrame, marked: DataFrame, words: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(id, mark, n_shingles, root, component) of documents (id, text) with their marked sets, a written table that is dropped, and links (a, b)
    between ids that hold the components together: those verified, and of equal sets each with the least id. Sets that share a
    signature are candidates; no link between two of a signature's sets is lost to its component."""
    light = scratch.table(marked.select("id", "mark", "n_shingles", F.col("high").alias("key")), "light")
    filled = light.where("n_shingles > 0")
    copies = scratch.table(filled.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")), "copies")
    members = buckets(scratch, marked)
    named = scratch.table(members.select(F.col("a").alias("key")).distinct().join(copies.select("key", "id"), "key"), "named")
    summary = marked.where("n_shingles > 0").select(F.col("high").alias("key"), "id", "n_shingles", "bits").join(named, ["key", "id"])
    summary = scratch.table(summary, "summary")
    if summary.count() > named.count():  # rows are repeated
        summary = scratch.table(summary.dropDuplicates(["key"]), "summary")
    scratch.drop(marked)
    scratch.release()
    linker = Linker(scratch, docs, summary, words, threshold)
    with letting_go(scratch.spark):
        link_all(linker, members)
    roots = copies.select("key", "id", "n")
    parts = hot_parts(copies, ["key"])
    if linker.labels is None:
        roots = roots.select("key", F.col("key").alias("root"), F.col("id").alias("component"))
    else:
        labelled = roots.join(linker.labels.select(F.col("id").alias("key"), F.col("component").alias("root")), "key")
        ids = scratch.table(labelled.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n")), "ids")
        linked = split_join(labelled, ids.select("root", "component"), ["root"], hot_parts(ids, ["root"])).select("key", "root", "component")
        alone = roots.join(linker.labels.select(F.col("id").alias("key")), "key", "left_anti").select("key", F.col("key").alias("root"), F.col("id").alias("component"))
        roots = scratch.table(linked.union(alone), "roots")
    placed = split_join(filled, roots, ["key"], parts).select("id", "mark", "n_shingles", "root", "component")
    none = light.where("n_shingles = 0").select("id", "mark", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("id").alias("component"))
    equal = split_join(filled.where("id is not null"), copies.select("key", F.col("id").alias("a")), ["key"], parts).where("id > a").select("a", F.col("id").alias("b"))
    if linker.links is not None:
        name = lambda k: copies.select(F.col("key").alias(k), F.col("id").alias(f"id_{k}"))
        between = linker.links.join(name("b"), "b").join(name("a"), "a").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        equal = equal.union(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return placed.union(none), equal.distinct()


def jaccard_groups(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), scratch: Scratch | None = None) -> DataFrame:
    """(id, mark, n_shingles, root, component) of documents (id, mark, text): rows of one root are linked, and component is the least
    id among them; rows without words have no root."""
    scratch = scratch or Scratch(docs.sparkSession, "partenum")
    marked = scratch.table(marked_sets(docs, words, threshold, sampled_order(scratch, docs, words)), "marked")
    return joined_groups(scratch, docs.select("id", "text"), marked, words, threshold)[0]


def jaccard_components(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(id, n_shingles, component) of documents (id, text). The component is the least id that links reach."""
    found = jaccard_groups(docs.select(F.col("id").cast("long"), F.lit(0).cast("long").alias("mark"), "text"), words, threshold)
    return found.select("id", "n_shingles", "component")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the least doc_id stays, all columns as they were.

    Rows without words, and rows with a null doc_id, are in no group and stay. Of rows that repeat a doc_id with the same text one
    stays; with different texts of one group one of them does; with texts of different groups each is kept or goes with its own."""
    id_, mark, text = fresh(docs, "id"), fresh(docs, "mark"), F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(text))
    scratch, result = Scratch(spark, "near-copies"), Scratch(spark, "gone")
    groups = jaccard_groups(keyed.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(mark).alias("mark"), "text"), scratch=scratch)
    rows = scratch.table(groups.where("root is not null").groupBy("root", "id", "mark").agg(F.count("*").alias("n")), "rows")
    sizes = scratch.table(rows.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("least")), "sizes")
    firsts = rows.join(sizes.select("root", F.col("least").alias("id")), ["root", "id"]).groupBy("root").agg(F.min("id").alias("kept"), F.min("mark").alias("own"))
    tested = split_join(rows, firsts, ["root"], hot_parts(sizes, ["root"]))
    gone = result.table(tested.where("id != kept or mark != own").select(F.col("id").alias(id_), F.col("mark").alias(mark)), "gone")
    again = result.table(rows.where("n > 1").select(F.col("id").alias(id_), F.col("mark").alias(mark)), "again")
    scratch.clear()
    sent = lambda x: F.broadcast(x) if x.count() <= MOST_BROADCAST else x
    kept = keyed.join(sent(gone), [id_, mark], "left_anti")
    if not again.isEmpty():
        several = kept.join(sent(again), [id_, mark], "left_semi").dropDuplicates([id_, mark])
        kept = kept.join(sent(again), [id_, mark], "left_anti").unionByName(several)
    return kept.select(docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, F.col("doc_id").alias("id"), "text")
    found = jaccard_components(docs, words=3, threshold=Fraction(9, 10))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


#: All pairs by brute force: for the small tables that the SQL check runs on.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
items AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS item FROM s),
common AS (SELECT item FROM items GROUP BY item HAVING count(*) > 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM (SELECT * FROM items WHERE item IN (SELECT item FROM common)) a
  JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 90 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, r.c AS component_id
FROM s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""
