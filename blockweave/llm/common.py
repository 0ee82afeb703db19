"""What the training-data operators share: shared-folder tables, text buffers, word hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.shared import shared_dir

#: Text bytes that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _small_batches(spark)
    df.write.parquet(path)
    gc.collect()
    _give_back()
    spark.sparkContext._jvm.System.gc()  # files of finished shuffles go once nothing refers to them
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the table that thins out texts before the exact join on their ids: a fixed size.
FILTER_BITS = 1 << 22


def thinned(docs: DataFrame, wanted: DataFrame, then: Callable | None = None, schema: str = "doc_id long, text string") -> DataFrame:
    """doc_id and text (or what `then` makes of their batches, in the same worker) of at least the documents whose
    doc_id is in `wanted`, and of few others: a bit table of fixed size, made from the wanted ids, drops most
    texts before a join has to move them. At any size it only saves work: the join that follows settles the
    rest."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = _bit_table(docs, wanted)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy().astype(np.uint64)
            keep = (bits.value[(at >> np.uint64(6)).astype(int)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(kept(batches)) if then else kept(batches)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("slot", slot)
    return read.mapInArrow(released(run), schema)


def _bit_table(docs: DataFrame, ids: DataFrame):
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("slot", slot).select(F.floor(F.col("slot") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words["w"].to_numpy(int)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(table)


def unused(columns: list[str], name: str) -> str:
    """`name`, or a longer one that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs`, all columns, in two: rows whose doc_id may be in `ids`, by a bit table of fixed size made from
    them, and rows whose doc_id is null or certainly not there, which need no join with `ids` and so no
    shuffle. At any size this only saves work: a join settles the first part."""
    bits = _bit_table(docs, ids)
    slot = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)), F.lit(-1))

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                u = np.maximum(at, 0).astype(np.uint64)
                met = (at >= 0) & (bits.value[(u >> np.uint64(6)).astype(int)] >> (u & np.uint64(63)) & np.uint64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(met == wanted))

        return docs.select("*", slot.alias(unused(docs.columns, "__slot"))).mapInArrow(released(run), docs.schema)

    return side(True), side(False)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is not in `ids`; null doc_ids stay."""
    some, rest = parted(docs, ids)
    return some.join(ids.select(F.col("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns).unionByName(rest)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(f: Callable) -> Callable:
    """`f` over batches, giving freed memory back to the system at the end: workers are used again by later
    stages, and what they hoard counts against their executor."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of the default 10,000 rows would take hundreds of MB in a worker and its JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about STEP_BYTES of text each, and their texts as UTF-8 (null: empty)."""
    col = batch.column(column).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, np.int64)
    at = 0
    while at < len(col):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), STEP_BYTES, "right")))
        yield batch.slice(at, n), [x or b"" for x in col.slice(at, n).to_pylist()]
        at += n


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", np.uint64(inverse))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of T[byte i] * P**i before each place; `(s[e] - s[b]) * P**-b` is the hash of bytes b to e."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def words(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of all texts in order; each
    word's text; and the first word of each text, with the number of words at the end."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _FOLD[raw]
    solid = ~space[data]
    edge = np.diff(np.concatenate(([False], solid)).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    s, (_, down) = prefix_hashes(data), powers(len(data))
    h = mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64) * _M1)
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))).astype(np.int64)
    first = np.searchsorted(start, begins)
    return h, np.repeat(np.arange(len(texts)), np.diff(first)), first


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; the whole sequence where it is shorter."""
    h, _, first = words(texts)
    n = len(h)
    roll = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        part = mix(h[j:] + np.uint64((j + 1) * int(_BASE) % 2**64))
        roll[: n - j] = mix(roll[: n - j] * _M2 + part) if j else part
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            own = np.array([b - a], np.uint64)
            for j in range(a, b):
                own = mix(own * _M2 + h[j : j + 1])
            out.append(own)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (v, component), component being the smallest id reached.

    Alternates large-star and small-star steps, whose minima are pre-aggregated before each shuffle, until every
    vertex hangs on its component's smallest. Vertices without an edge are absent. No part of the graph is
    collected. Minima are written as tables: both sides of each join are then plain shuffles, whose hot keys
    Spark can split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, "edges")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        old, e = e, written(small, "edges")
        dropped(old, least, large, low)
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(e.select(F.col("v"), F.col("v").alias("component")).distinct())


def _all_stars(e: DataFrame) -> bool:
    """Whether no vertex has two edges down, or both one down and one up."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.where("down > 1 OR down > 0 AND up > 0").isEmpty()
