"""Near-duplicate components by compressed MinHash registers (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import components, dropped, mix, released, shingles, sliced, steps, thinned, written

REGISTERS, BAND_ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND_ROWS
_VALUE_BITS = 64 - REGISTERS.bit_length() + 1
EMPTY = np.uint16(0xFFFF)
#: Standard deviations by which an estimate may fall short before a pair goes unverified.
SLACK = 5.0
#: Members of a bucket that one comparing task holds of either side, and shingles of their sets (one set may have
#: more).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21


@lru_cache(1)
def _walks() -> np.ndarray:
    """For each register, the order in which an empty one looks for a filled one."""
    keys = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS)
    return np.argsort(keys, axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers, uint16: the leading-zero count of each bucket's smallest value over MANTISSA bits
    that follow the first one. The top bits of a hash name its bucket, so a sorted set lists the buckets'
    minima in order. Empty registers borrow from filled ones along a fixed walk."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_VALUE_BITS)
    low = np.full((len(sets), REGISTERS), np.uint64(0), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, bounds)
            ok = at < len(s)
            v = s[np.minimum(at, len(s) - 1)]
            full[i] = ok & (v >> np.uint64(_VALUE_BITS) == np.arange(REGISTERS, dtype=np.uint64))
            low[i] = v & np.uint64((1 << _VALUE_BITS) - 1)
    v = np.maximum(low >> np.uint64(_VALUE_BITS - 53), np.uint64(1))
    length = np.frexp(v.astype(np.float64))[1]
    lead = (53 - length).astype(np.uint64)
    after = (v << lead.astype(np.uint64)) & np.uint64((1 << 52) - 1)
    reg = (lead << np.uint64(MANTISSA) | after >> np.uint64(52 - MANTISSA)).astype(np.uint16)
    walks, out = _walks(), np.where(full, reg, EMPTY)
    need = ~full & full.any(axis=1, keepdims=True)
    for t in range(REGISTERS):
        if not need.any():
            break
        i, j = np.nonzero(need)
        source = walks[j, t]
        hit = full[i, source]
        out[i[hit], j[hit]] = reg[i[hit], source[hit]]
        need[i[hit], j[hit]] = False
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(reg).view(np.uint64)
    return mix(words ^ mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1009))).view(np.int64)


@lru_cache(4096)
def chance(log_a: int, log_b: int) -> float:
    """How often registers of two unrelated sets agree, their sizes being 2**(log/2): the sum over cells of
    the product of both minima's chances to fall there."""
    edges = np.concatenate([2.0**-z * (1 - np.arange(2**MANTISSA) / 2 ** (MANTISSA + 1)) for z in range(40)] + [[0.0]])
    cells = [-np.diff(1 - np.exp(max(1e-9, 2 ** (g / 2) / REGISTERS) * np.log1p(-np.minimum(edges, 1 - 1e-12)))) for g in (log_a, log_b)]
    return float((cells[0] * cells[1]).sum())


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one set against many, freed of chance agreements."""
    agree = (a == b).mean(axis=1)
    logs = np.round(2 * np.log2(np.maximum(n_b, 1))).astype(int)
    c = np.zeros(len(b))
    for g in np.unique(logs):
        c[logs == g] = chance(int(round(2 * np.log2(max(n_a, 1)))), int(g))
    return (agree - c) / (1 - c)


def near(n_a: int, n_b: np.ndarray, est: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that go on to verification: sizes allow the similarity and the estimate is not clearly below it."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    p = percent / 100
    return (100 * small >= percent * large) & ((large < 32) | (est >= p - SLACK * np.sqrt(p * (1 - p) / np.minimum(REGISTERS, large))))


def linked(n_both: np.ndarray, n_a: int, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, registers and band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch):
                sets = shingles(texts, k)
                reg = registers(sets)
                keys = band_keys(reg)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([r.tobytes() for r in reg], pa.binary()), pa.array([list(x) if len(s) else None for x, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "reg", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, reg binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, n, reg, set (sorted 64-bit hashes) of the documents in `wanted`. Texts
    are thinned out before they are hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch):
                sets = shingles(texts, k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in registers(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "reg", "set"])

    found = thinned(docs, wanted, run, "doc_id long, n long, reg binary, set binary")
    return found.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _verify(percent: int):
    """Links among pairs (a, n_a, reg_a, set_a, b, n_b, reg_b, set_b): estimate first, then whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                n_b = np.array([c["n_b"][i]])
                est = estimate(np.frombuffer(c["reg_a"][i], np.uint16), np.frombuffer(c["reg_b"][i], np.uint16)[None], c["n_a"][i], n_b)
                if near(c["n_a"][i], n_b, est, percent)[0]:
                    both = len(np.intersect1d(np.frombuffer(c["set_a"][i], np.uint64), np.frombuffer(c["set_b"][i], np.uint64), assume_unique=True))
                    if linked(np.array([both]), c["n_a"][i], n_b, percent)[0]:
                        out.append((c["a"][i], c["b"][i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def _rivals(percent: int):
    """Of one visit (members of one block, and `odd` ones of another, all of one bucket): those of either side that
    by their registers may be linked with one of the other side from another component, and that share no
    earlier band with it."""

    def run(table: pa.Table) -> pa.Table:
        component = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        reg = np.frombuffer(b"".join(table.column("reg").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys, n = band_keys(reg), table.column("n").to_numpy()
        odd, member = (np.array(table.column(c).to_pylist()) for c in ("odd", "member"))
        band, whole, keep = table.column("band")[0].as_py(), np.flatnonzero(member), np.zeros(len(n), bool)
        for i in np.flatnonzero(odd):
            mine = whole[component[whole] != component[i]]
            mine = mine[(keys[mine] == keys[i]).argmax(axis=1) == band] if len(mine) else mine
            if len(mine):
                mine = mine[near(int(n[i]), n[mine], estimate(reg[i], reg[mine], int(n[i]), n[mine]), percent)]
                keep[mine] = True
                keep[i] |= len(mine) > 0
        return table.filter(pa.array(keep))

    return run


def _forest(percent: int):
    """Links that join different components, among what is left of one visit (see _rivals). A pair is compared in
    the first band it shares, by estimate and then on whole sets, and only while both are in different
    components."""

    def run(table: pa.Table) -> pa.Table:
        names: dict = {}
        root = [names.setdefault(x, i) for i, x in enumerate(table.column("component").to_pylist())]

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        reg = np.frombuffer(b"".join(table.column("reg").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys, n, ids = band_keys(reg), table.column("n").to_numpy(), table.column("doc_id").to_pylist()
        odd, member = (np.array(table.column(c).to_pylist()) for c in ("odd", "member"))
        sets, band = table.column("set"), table.column("band")[0].as_py()
        one = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
        out, whole = [], np.flatnonzero(member)
        for i in np.flatnonzero(odd):
            mine = whole[[find(j) != find(i) for j in whole]] if len(whole) else whole
            mine = mine[(keys[mine] == keys[i]).argmax(axis=1) == band] if len(mine) else mine
            if len(mine):
                est, x = estimate(reg[i], reg[mine], int(n[i]), n[mine]), one(i)
                ok = near(int(n[i]), n[mine], est, percent)
                for j in mine[ok][np.argsort(-est[ok], kind="stable")]:
                    if find(i) != find(j):
                        y = one(j)
                        both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                        if linked(np.array([both]), int(n[i]), n[j : j + 1], percent)[0]:
                            out.append((ids[i], ids[j]))
                            root[find(i)] = find(j)
        return pa.table([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def repeated(sketch: DataFrame) -> bool:
    """Whether some doc_id has texts with different sets."""
    ids = sketch.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.xxhash64("digest"), F.lit(0)).alias("h"))
    return not ids.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty()


def _by_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates where a doc_id has different texts: each row under a number of its own, and of each component
    the smallest doc_id in the end."""
    rows = written(docs.where("doc_id IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("own"), "text"), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), k, percent).withColumnsRenamed({"doc_id": "row", "component_id": "c"})
    named = written(found.join(rows.select("row", "own"), "row").select("own", "n_shingles", "c"), "named")
    least = written(named.groupBy("c").agg(F.min("own").alias("component_id")), "least")
    whole = named.join(least, "c").select(F.col("own").alias("doc_id"), "n_shingles", "component_id", (F.col("own") == F.col("component_id")).alias("kept"))
    none = sketches(docs.where("doc_id IS NULL"), k).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    out = written(whole.unionByName(none), "neardup")
    dropped(rows, named, least)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents linked by 100 * intersection >=
    percent * union of their k-word shingle sets.

    1. Each text gives its set's size and digest and compressed registers; equal sets are one class, whose
       smallest doc_id goes on, so copies are never compared.
    2. Registers are cut into bands; members of a bucket are paired with two of them, by id and by a hash, and
       the pairs verified on whole sets after the collision-corrected estimate; links give components.
    3. Buckets whose members are still in several components are compared exactly, the members outside the
       bucket's main component against all of it, in blocks, by tasks that return only links which join
       components. So every pair that shares a band is either compared or already connected.

    A pair of similarity 0.8 shares none of the 32 bands with a chance below 1e-7. Texts that are null, empty
    or white space have an empty set, no link and themselves as component. Fewer words than k: the whole
    sequence is the one shingle. Rows that repeat a doc_id come out once each; where their texts differ, each row is
    a text of its own, and its component is the smallest doc_id of those it reaches. Rows without a doc_id are
    kept, with a null component and kept = true.
    """
    sketch = written(sketches(docs, k), "sketch")
    if repeated(sketch):
        dropped(sketch)
        return _by_rows(docs, k, percent)
    filled = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Aggregates as tables: a join with them is of two plain shuffles, whose hot keys Spark can split.
    classes = written(filled.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    member = written(filled.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id"), "member")
    heads = member.select(F.col("class_id").alias("doc_id")).distinct()
    spread = filled.join(heads, "doc_id", "left_semi").select("doc_id", F.posexplode("bands").alias("band", "key"))
    spread = written(spread, "bands")
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"))
    buckets = spread.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("doc_id").alias("first"), F.min(order)["d"].alias("second")).where("size > 1")
    buckets = written(buckets, "sizes")
    full = written(spread.join(buckets, ["band", "key"]), "buckets")
    pairs = full.select("doc_id", F.explode(F.array("first", "second")).alias("b")).where("doc_id <> b").select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    sets = written(full_sets(docs, full.select("doc_id").distinct(), k), "sets")

    def side(s: str) -> DataFrame:
        return sets.toDF(s, f"n_{s}", f"reg_{s}", f"set_{s}")

    links = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(_verify(percent)), "a long, b long"), "links")
    found = components(links)

    label = F.coalesce("component", "doc_id").alias("component")
    in_part = full.select("band", "key", "doc_id").join(found.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("band", "key", "doc_id", label)
    parts = written(in_part, "parts")
    tally = parts.groupBy("band", "key", "component").count().groupBy("band", "key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "component"))["component"].alias("main")).where("parts > 1")
    tally = written(tally, "tally")
    signed = sets.select("doc_id", "n", "reg")
    mixed = written(parts.join(tally, ["band", "key"]).withColumn("odd", F.expr("component <> main")).join(sets.select("doc_id", "n"), "doc_id"), "mixed")
    # Blocks of about BLOCK members and BLOCK_SHINGLES shingles, of all members and of the odd ones: each member
    # meets each block of odd ones, in a task of its block and theirs.
    sizes = [F.greatest(F.ceil(F.count_if(c) / BLOCK), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("long").alias(name) for c, name in ((F.lit(True), "blocks"), (F.col("odd"), "odd_blocks"))]
    buckets_of = written(mixed.groupBy("band", "key").agg(*sizes), "blocks")
    seated = mixed.join(buckets_of, ["band", "key"]).withColumns({"x": F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("odd_blocks")), "y": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks"))})
    place = ["band", "key", "x", "y", "doc_id", "component"]
    as_member = seated.withColumn("x", F.explode(F.expr("sequence(0L, odd_blocks - 1)"))).select(*place, F.lit(True).alias("member"), F.lit(False).alias("odd"))
    as_odd = seated.where("odd").withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(*place, F.lit(False).alias("member"), F.lit(True).alias("odd"))
    visits = as_member.unionByName(as_odd).groupBy(*place).agg(F.max("member").alias("member"), F.max("odd").alias("odd"))
    shape = "doc_id long, band int, key long, x long, y long, component long, member boolean, odd boolean, n long, reg binary"
    # Registers first; whole sets only go to where they may link.
    left = visits.join(signed, "doc_id").select(*[c.split()[0] for c in shape.split(", ")])
    left = written(left.groupBy("band", "key", "x", "y").applyInArrow(_rivals(percent), shape), "rivals")
    more = left.join(sets.select("doc_id", "set"), "doc_id").groupBy("band", "key", "x", "y").applyInArrow(_forest(percent), "a long, b long")
    late = written(more, "late")
    # Components of the late links' own graph, whose vertices are the components found first.
    top = found.select(F.col("v"), F.col("component"))
    ends = late.join(top.toDF("a", "ca"), "a", "left").join(top.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(ends)
    of_class = found.unionByName(late.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(found, "v", "left_anti").select("v", F.col("v").alias("component")))
    of_class = of_class.join(joined.toDF("component", "higher"), "component", "left").select(F.col("v").alias("class_id"), F.coalesce("higher", "component").alias("component_id"))
    whole = member.join(of_class, "class_id", "left").select("doc_id", F.coalesce("component_id", "class_id").alias("component_id")).dropDuplicates(["doc_id"])
    rows = sketch.select("doc_id", "n_shingles").join(whole, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = written(rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "neardup")
    dropped(sketch, classes, member, spread, buckets, full, pairs, sets, links, found, parts, tally, mixed, buckets_of, left, late, joined)
    return out
