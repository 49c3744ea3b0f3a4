"""Best-fit packing of tokenised documents by bin completion.

Documents longer than a sequence are cut into pieces of full length, the first of which may be shorter; so all that is left to pack is
how often each piece length occurs. That histogram has one row per length up to the capacity, however large the corpus, and it alone
goes to the driver. There a branch-and-bound search completes bins: it takes the largest length left, enumerates the fillings of the
space beside it that no other dominates (a piece that is left in place of several of its sum, or of a smaller one that wastes more),
least waste first, applies the chosen pattern as often as the counts allow, and drops branches whose waste reaches that of the best
solution known. The first such solution is best-fit decreasing. The search ends at the lower bound, or after `max_nodes` steps with the
best solution so far; a node looks at a bounded number of fillings, as the parameters of `fillings` and `complete_bins` say. What those
bounds cost is at most the gap between the result and `lower_bound`, and no piece.

Pieces are ranked within their length (in two levels, so no length meets in one task) and find their place by a join with the
patterns' slots. Defined results: null and empty texts are one piece, the end id alone; very long texts are as many pieces as they fill;
repeated rows are packed each; null ids are
allowed; extra columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, gathered, small_table, whole_array
from .mixing import CELL_DOCS, running

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that a task encodes at once.
TEXT_AT_ONCE = 2 << 20


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Stand for a line end, and for the lack of a blank before a word, while a text is cut; texts that hold them are encoded whole.
LINE, BARE = "\ue000", "\ue001"


class Encoder:
    """Token ids of texts. A blank or line end between visible characters always separates tokens, as does what ends a word of
    letters; so each word is encoded once, remembered, and put together again. Texts with other runs of white space, control
    characters or the two signs above are encoded whole."""

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a character of a byte-level token is a byte
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.pool, self.filled, self.count = np.zeros(1024, np.int64), np.zeros(1 << 16, np.uint32), 0, 1

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def remember(self, new: list[str]) -> None:
        """Encodes words with a blank before them, or words without, in long texts, and finds them again by their bytes."""
        for blank in (True, False):
            own = [w for w in new if w.startswith(" ") == blank]
            for a in range(0, len(own), 4000):
                block = own[a : a + 4000]
                ids = np.asarray(self.tokenizer.encode_batch_fast([("" if blank else "\n").join(block)], add_special_tokens=False)[0].ids, np.uint32)
                size = np.fromiter((len(w.encode()) for w in block), np.int64, len(block))
                first = np.cumsum(size + (not blank)) - (size + (not blank))
                place = np.concatenate([[0], np.cumsum(self.width[ids])])
                low, high = np.searchsorted(place, first), np.searchsorted(place, first + size)
                kept = np.ones(len(ids), bool)
                if not blank:
                    kept[high[:-1]] = False
                self.append(block, ids[kept], high - low)

    def append(self, block: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(block)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.starts[self.count : self.count + n] = self.filled + np.cumsum(lengths) - lengths
        self.known.update(zip(block, range(self.count, self.count + n)))
        self.filled += len(ids)
        self.count += n
        self.starts[self.count] = self.filled

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = {w for w in words if w not in known}
        if new:
            if len(known) + len(new) > self.remembered:
                self.clear()
                known, new = self.known, set(words) - {""}
            self.remember(sorted(new))
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        texts = whole_array(texts)
        if not len(texts):
            return []
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.replace_substring(texts, "\n", f" {LINE} {BARE}"), pa.scalar(BARE, pa.large_string())), " ")
        parts, at = split.flatten(), np.asarray(split.offsets, np.int64)
        coded = parts.dictionary_encode()
        words = coded.dictionary
        bare = pc.starts_with(words, BARE)
        body = pc.if_else(bare, pc.utf8_slice_codeunits(words, 1), words)
        line = pc.equal(words, LINE)
        odd = pc.or_(pc.equal(body, ""), pc.match_substring_regex(body, r"[\x00-\x20\x7f-\x{a0}\x{e000}\x{e001}]|\p{Z}"))
        odd = np.asarray(pc.and_not(odd, line).cast(pa.uint8()), bool)
        core = pc.utf8_rtrim(body, ".,;:!?")
        core = pc.if_else(pc.match_substring_regex(core, r"[\p{L}\p{N}]$"), core, body)
        heads = pc.if_else(line, "\n", pc.if_else(bare, core, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), core, pa.scalar("", pa.large_string()))))
        heads = pc.if_else(pa.array(odd), "", heads).dictionary_encode()
        ended = np.flatnonzero(np.asarray(pc.not_equal(body, core).cast(pa.uint8()), bool) & ~odd)
        texts_of = lambda x: x.take(pa.array(ended)).to_numpy(zero_copy_only=False).tolist()
        endings = pa.array([b[len(c) :] for b, c in zip(texts_of(body), texts_of(core))], pa.string()).dictionary_encode()
        known = self.numbers([*heads.dictionary.to_numpy(zero_copy_only=False).tolist(), *endings.dictionary.to_pylist()])
        head, ending = known[: len(heads.dictionary)], known[len(heads.dictionary) :]
        head, tail = head[np.asarray(heads.indices)], np.zeros(len(words), np.int64)
        tail[ended] = ending[np.asarray(endings.indices)] if len(ended) else 0

        segments = np.empty(2 * len(words), np.int64)
        segments[::2], segments[1::2] = head, tail
        first = self.starts[segments]
        lengths = self.starts[segments + 1] - first
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(first - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        per_word = np.concatenate([[0], ends[1::2]]).astype(np.int32)
        of_words = pa.ListArray.from_arrays(pa.array(per_word), pa.array(flat)).take(coded.indices)
        ids = np.asarray(of_words.flatten())
        places = np.asarray(of_words.offsets, np.int64)[at]
        plain = np.ones(len(texts), bool)
        if odd.any():
            odd_before = np.concatenate([[0], np.cumsum(odd[np.asarray(coded.indices)])])
            plain = odd_before[at[1:]] == odd_before[at[:-1]]
        other = iter(self.whole(texts.filter(pa.array(~plain)).to_pylist()) if not plain.all() else [])
        end = np.array([END_ID], np.uint32)
        return [np.concatenate([ids[a:b] if p else np.asarray(next(other), np.uint32), end]) for a, b, p in zip(places[:-1], places[1:], plain)]


_encoders: dict[str, Encoder] = {}


def cut_texts(batches, path: str, capacity: int):
    """Pieces of batches (doc_id, text), some MB of text at a time."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]
    try:
        for batch in gathered(batches, 1, TEXT_AT_ONCE):
            owner, piece, start, length, ids = [], [], [], [], []
            for i, own in enumerate(encoder.encode(batch.column(1))):
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(own[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(owner, pa.int32())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary())})
            pa.default_memory_pool().release_unused()
    finally:
        encoder.clear()  # the worker stays for other tasks, the words needn't
        pa.default_memory_pool().release_unused()


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, cut to the capacity; ids as little-endian 32 bits."""
    path = tokenizer or tokenizer_path()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: cut_texts(batches, path, capacity), "doc_id long, piece int, start long, length long, ids binary")


@dataclass
class Pattern:
    lengths: list[int]  # of the pieces in one sequence, largest first
    times: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Largest first, each bin filled with the largest that fits, as often as the counts allow."""
    counts, out = dict(counts), []
    sizes = sorted(counts, reverse=True)
    while sizes:
        lengths, space, left = [], capacity, dict.fromkeys(sizes, 0)
        for s in sizes:
            n = min(space // s, counts[s])
            if n:
                lengths += [s] * n
                left[s] = n
                space -= n * s
        times = min(counts[s] // n for s, n in left.items() if n)
        out.append(Pattern(lengths, times))
        for s, n in left.items():
            counts[s] -= n * times
        sizes = [s for s in sizes if counts[s]]
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing does without: by total length, and for each k by the pieces over capacity - k, which take a bin that none of
    k or more shares, those over half of it, and what of the others of k or more doesn't fit beside these."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in [0, *(s for s in counts if 2 * s <= capacity)]:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = [(s, n) for s, n in counts.items() if capacity - k >= s > capacity / 2]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        room = sum((capacity - s) * n for s, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def as_bits(sizes) -> int:
    found = 0
    for s in sizes:
        found |= 1 << s
    return found


def dominated(fill: list[int], counts: dict[int, int], waste: int, left: int | None = None) -> bool:
    """Whether one piece that is left could stand in place of several of the filling, of their sum or up to `waste` more, or of one that
    is smaller by up to `waste`: the filling with that piece leaves the easier ones for other bins. Sets of sizes and of sums are the
    bits of whole numbers; `left` has those counted."""
    left = as_bits(s for s, n in counts.items() if n) if left is None else left
    left &= ~as_bits(s for s in set(fill) if counts.get(s, 0) <= fill.count(s))
    sums, several = 1, 0  # sums of some of the pieces, of none too; of two or more
    for s in fill:
        several |= (sums & ~1) << s
        sums |= sums << s
    larger, reach = (sums & ~1) << 1, 1  # sums and up to `reach` more
    while reach < waste:
        larger |= larger << min(reach, waste - reach)
        reach = min(2 * reach, waste)
    return bool(several & left or waste > 0 and larger & left)


def fillings(counts: dict[int, int], sizes: list[int], space: int, most: int, width: int = 3) -> list[list[int]]:
    """Up to `most` undominated fillings of the space with at most `width` pieces before best fit ends them, least waste first."""
    found: dict[tuple[int, ...], int] = {}
    if counts.get(space):
        return [[space]]
    usable = [s for s in sizes if s <= space]
    present = {s for s in usable if counts[s]}
    steps = 0

    def extend(chosen: list[int], space: int, at: int) -> None:
        nonlocal steps
        if space in present and counts[space] > chosen.count(space) and (not chosen or space <= chosen[-1]):
            found[(*chosen, space)] = 0
            return
        grown = False
        for i in range(at, len(usable)):
            s = usable[i]
            steps += 1
            if steps > 2000 or len(found) >= 4 * most:
                return
            if s > space or counts[s] <= chosen.count(s):
                continue
            grown = True
            if len(chosen) + 1 < width:
                extend([*chosen, s], space - s, i)
            else:
                rest, tail, own = space - s, [*chosen, s], 0
                for t in usable[i:]:
                    own = min(rest // t, counts[t] - tail.count(t)) if t <= rest else 0
                    tail += [t] * max(own, 0)
                    rest -= t * max(own, 0)
                found.setdefault(tuple(tail), rest)
        if not grown and chosen:
            found.setdefault(tuple(chosen), space)

    extend([], space, 0)
    ordered = sorted(found.items(), key=lambda kv: (kv[1], len(kv[0]), [-x for x in kv[0]]))
    left = as_bits(s for s, n in counts.items() if n)
    undominated = list(islice((list(k) for k, waste in ordered if not dominated(list(k), counts, waste, left)), most))
    return undominated or [list(k) for k, _ in ordered[:1]] or [[]]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = 5_000, branches: int = 3) -> list[Pattern]:
    """Patterns that pack the counted lengths into as few bins as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = lambda patterns: sum(p.times for p in patterns)
    nodes, fewest = 0, bins(best)

    def search(counts: dict[int, int], done: list[Pattern], waste: int) -> bool:
        """Depth first with a list in place of recursion, so deep corpora don't meet a limit; True when the bound is reached."""
        nonlocal best, nodes, fewest
        stack = [(counts, done, waste)]
        while stack and nodes < max_nodes:
            counts, done, waste = stack.pop()
            nodes += 1
            if waste >= fewest * capacity - total:
                continue
            sizes = sorted((s for s, n in counts.items() if n), reverse=True)
            if not sizes:
                best, fewest = done, bins(done)
                if fewest <= bound:
                    return True
                continue
            largest = sizes[0]
            rest = {**counts, largest: counts[largest] - 1}
            options = fillings(rest, [s for s in sizes if rest[s]], capacity - largest, branches)
            for fill in reversed(options):
                lengths = [largest, *fill]
                need = {s: lengths.count(s) for s in set(lengths)}
                times = min(counts[s] // n for s, n in need.items())
                left = {s: n - need.get(s, 0) * times for s, n in counts.items()}
                stack.append(({s: n for s, n in left.items() if n}, [*done, Pattern(lengths, times)], waste + (capacity - sum(lengths)) * times))
        return False

    if fewest > bound:
        search(counts, [], 0)
    return best


def slots_of(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """(length, low, high, per, sequence, offsets): pieces of a length ranked low to high go to sequences of one pattern."""
    rows, used, sequence = [], {}, 0
    for p in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for s in p.lengths:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, places in offsets.items():
            low = used.get(s, 0)
            used[s] = low + len(places) * p.times
            rows.append((s, low, used[s], len(places), sequence, places))
        sequence += p.times
    return small_table(spark, rows, "length long, low long, high long, per int, sequence long, offsets array<long>")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), a written table whose rows are read twice."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(spark, complete_bins(counts, capacity))
    bits = max(1, math.ceil(math.log2(max([1, *counts.values()]) / CELL_DOCS + 1)) + 1)
    keyed = pieces.withColumn("_h", F.xxhash64("doc_id", "piece")).withColumn("_cell", F.shiftrightunsigned("_h", 64 - bits)).withColumn("_one", F.lit(1))
    order = [F.col("_h"), F.col("doc_id"), F.col("piece"), F.col("start")]
    ranked = running(keyed, ["length"], "_cell", "_one", order, "_rank")
    placed = ranked.join(F.broadcast(slots), "length").where("_rank >= low and _rank < high")
    place = F.col("_rank") - F.col("low")
    return placed.withColumn("sequence_id", F.col("sequence") + F.floor(place / F.col("per")).cast("long")).withColumn("offset", F.element_at("offsets", (place % F.col("per") + 1).cast("int"))).select(*pieces.columns, "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): whole training sequences; ids as little-endian 32 bits."""
    scratch = Scratch(docs.sparkSession, "packing")
    packed = pack(scratch.table(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most `capacity` pieces
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("p"))
    return rows.select("sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (acc, x) -> concat(acc, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the packing with a checksum in place of the ids."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = token_pieces(docs, tokenizer, capacity)
    light = scratch.table(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(light, capacity)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage, the last: every piece of every document with its place in a sequence."""
    return packed_pieces(docs.select("doc_id", "text"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir, "doc_id", "text"))
