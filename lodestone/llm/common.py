"""What the corpus operators share: scratch tables in the cluster's shared folder, and shingle hashing in numpy."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, as the contracts' word pattern has it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Whether Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a one-machine session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-lodestone-")
    return _own_folder[app]


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of whole texts are large: unless the session sets their rows itself, a batch holds so many."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def letting_go(spark: SparkSession):
    """Queries within delete what they shuffled when they end, not when the driver collects its garbage: it isn't read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables written below the shared folder. Writing one cuts lineage; lost executors cost a reread, not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        text_batches(spark)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with letting_go(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch that nothing reads any more."""
        paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Deletes all tables of this scratch; what is still needed is in another's."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Lets the driver drop shuffle files that no live DataFrame can reach."""
        gc.collect()
        self.spark._jvm.System.gc()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, sent as Arrow: as plain rows they would be read by Python workers that stay in every executor."""
    fields = T.StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [()] * len(fields)
    kinds = to_arrow_schema(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.types)], schema=kinds), fields)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken, found = {c.lower() for c in df.columns}, f"_{name}"
    while found.lower() in taken:
        found = f"_{found}"
    return found


#: A key is hot if it holds more than 1 / HOT of a table's rows, and more than HOT rows.
HOT = 1000


def hot_parts(counts: DataFrame, on: list[str]) -> DataFrame | None:
    """(on, _parts): the hot keys of (on, n), at most HOT of them, and into how many parts each is to be cut; None if there are none."""
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    most = max(HOT, (total or 0) // HOT)
    if (largest or 0) <= most:
        return None
    hot = [tuple(r) for r in counts.where(F.col("n") > most).select(*on, "n").collect()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*on).schema.fields)
    return small_table(counts.sparkSession, [(*key, -(-n // most)) for *key, n in hot], f"{schema}, _parts long")


def split_join(left: DataFrame, right: DataFrame, on: list[str], parts: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key at most once. The rows of hot keys (see hot_parts) are dealt into parts by a hash, and
    right's rows repeated for each part, so that no task gets all rows of one key."""
    if parts is None:
        return left.join(right, on, how)
    parts = F.broadcast(parts)
    dealt = left.join(parts, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*left.columns), "_parts"), F.lit(0)).cast("long")).drop("_parts")
    repeated = right.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("*",))


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 0 when divided by 5: such rows' labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gathered(batches, column: int, most: int = 6 << 20):
    """Batches put together to some `most` bytes of text, for work that repeats per batch; at least one, though empty."""
    held, size = [], 0
    for batch in sliced(batches, column):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def whole_array(texts: pa.Array) -> pa.Array:
    """Large strings without nulls in memory of their own: some text kernels misread an array that is a slice of another."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def encode_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space of each text: codes into a dictionary, the dictionary, and where each text starts."""
    texts = whole_array(texts)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, starts = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
    starts = starts - starts[0]
    filled = np.asarray(pc.not_equal(words, "").cast(pa.uint8()), dtype=np.int64)
    if not filled.all():
        kept = np.concatenate([[0], np.cumsum(filled)])
        words, starts = words.filter(pc.not_equal(words, "")), kept[starts]
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary, starts


def slices(batch: pa.RecordBatch, column: int, most: int = 3 << 20):
    """Parts of a batch with some `most` bytes of text each (a longer text alone), so memory doesn't follow the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    part = np.cumsum(np.asarray(lengths, np.int64)) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            yield batch.take(pa.array(np.arange(a, b)))


def sliced(batches, column: int):
    for batch in batches:
        yield from slices(batch, column)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct elements in order; np.unique without its detour by a hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def rolled_words(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the dictionary's words, each word's code, where each text starts, and a hash of the n words from each place on."""
    codes, dictionary, starts = encode_words(texts)
    # as a numpy array: a list of so many Python strings takes longer than their hashes
    words = dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    named = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    rolled = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        mixed = [mix64(named + np.uint64(i)) for i in range(n)]  # a word of the dictionary is mixed once for each place in a shingle
        for a in range(0, len(rolled), 1 << 14):
            part = rolled[a : a + (1 << 14)]
            for i in range(n):
                part *= MIX
                part += mixed[i][codes[a + i : a + i + len(part)]]
            part[:] = mix64(part)
    return named, codes, starts, rolled


def shingles_of(named: np.ndarray, codes: np.ndarray, starts: np.ndarray, rolled: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's shingles in their order, repeats too; with fewer words than n, the whole sequence as one."""
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= n:
                out.append(rolled[a : b - n + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in named[codes[a:b]]:
                    whole = whole * MIX + mix64(w)
                out.append(mix64(np.array([whole])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sets_of(named: np.ndarray, codes: np.ndarray, starts: np.ndarray, rolled: np.ndarray, n: int) -> list[np.ndarray]:
    return [distinct(x) for x in shingles_of(named, codes, starts, rolled, n)]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; with fewer words, the whole sequence as one."""
    return sets_of(*rolled_words(texts, n), n)
