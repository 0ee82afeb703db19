"""Exact removal of repeated byte strings by hash-compared suffix sort (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import dropped, mix, parted, powers, prefix_hashes, released, sliced, steps, thinned, unused, written

LENGTH, SEED = 100, 24
#: Bytes of one numpy step within a long text.
CHUNK = 1 << 18
#: Distinct stretches that one task sorts together; larger groups are split by more context first.
GROUP = 1024


def _range_hash(s: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (s[end] - s[begin]) * down[begin]


def segments(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, start, count, seed hash, stretch hash) of the segments of all texts.

    Each window of `length` bytes names the leftmost of the smallest `seed`-byte hashes in it, so equal
    windows name the same place within them. A segment is a run of windows that name one place; its stretch
    is the bytes that they cover. Segments partition the windows.
    """
    parts = [(i, at, x[at : at + CHUNK + length - 1]) for i, x in enumerate(texts) for at in range(0, max(0, len(x) - length + 1), CHUNK)]
    out: list[tuple] = []
    while parts:
        n, total = 0, 0
        while n < len(parts) and (not n or total + len(parts[n][2]) <= 2 * CHUNK):
            total, n = total + len(parts[n][2]), n + 1
        own, parts = parts[:n], parts[n:]
        data = np.frombuffer(b"".join(x for _, _, x in own), np.uint8)
        sizes = np.array([len(x) for _, _, x in own])
        begins = np.concatenate(([0], np.cumsum(sizes)))
        s, (_, down) = prefix_hashes(data), powers(len(data))
        grams = mix(_range_hash(s, down, np.arange(len(data) - seed + 1), np.arange(seed, len(data) + 1)))
        low = grams & ~np.uint64((1 << 24) - 1) | np.arange(len(grams), dtype=np.uint64)
        width, step = length - seed + 1, 1
        while step * 2 <= width:
            low, step = np.minimum(low[:-step], low[step:]), step * 2
        if width > step:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        of = np.repeat(np.arange(n), sizes)[: len(place)]
        inside = np.arange(len(place)) + length <= begins[of + 1]
        fresh = inside & np.concatenate(([True], (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]))
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(np.cumsum(inside)[first] - 1, inside.sum()))
        stretch = mix(_range_hash(s, down, first, first + count + length - 1) + count.astype(np.uint64))
        text, at = np.array([i for i, _, _ in own])[of[first]], np.array([a for _, a, _ in own])[of[first]]
        out.append((text, first - begins[of[first]] + at, count, grams[place[first]], stretch))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Suffixes:
    """Strings of one buffer, each a start and a size, compared by hashes of their prefixes: the common
    extension of two is found by binary search."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.ascontiguousarray(data)
        self.sums, (_, self.down) = prefix_hashes(self.bytes), powers(len(self.bytes))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at a and b, at most `most`."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            same = _range_hash(self.sums, self.down, x, x + mid) == _range_hash(self.sums, self.down, y, y + mid)
            low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
        return low

    def sort(self, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings by group (ascending on input) and bytes, and for each place of the order the
        common prefix with the string before it, -1 at a group's first.

        A bottom-up merge sort of all groups at once: each string's rank in the neighbouring run is found by
        binary search over comparisons by common extension. The prefixes returned are checked byte by byte
        against collisions.
        """
        n = len(start)
        order, bounds = np.arange(n), np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, int)
        first, last = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
        run, largest = 1, int(np.diff(bounds).max(initial=0))
        while run < largest:
            place = np.arange(n)
            mine = (place - first) // run
            left = mine % 2 == 0
            begin = np.minimum(np.where(left, first + (mine + 1) * run, first + (mine - 1) * run), last)
            low, high = begin.copy(), np.minimum(begin + run, last)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                x, y = order[mid], order[open_]
                most = np.minimum(size[x], size[y])
                same = self.extension(start[x], start[y], most)
                full = same == most
                i, j = (np.where(full, 0, start[z] + same) for z in (x, y))
                less = np.where(full, (size[x] < size[y]) | (size[x] == size[y]) & ~left[open_], self.bytes[i] < self.bytes[j])
                low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
            own = np.where(left, place, begin + place - (first + mine * run))
            merged = np.empty(n, np.int64)
            merged[own + low - begin] = order
            order, run = merged, run * 2
        prefix = np.full(n, -1)
        at = np.flatnonzero(group[1:] == group[:-1]) + 1
        x, y = order[at - 1], order[at]
        prefix[at] = self._checked(start[x], start[y], self.extension(start[x], start[y], np.minimum(size[x], size[y])))
        return order, prefix

    def _checked(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
        """`same`, or the true common prefix where it is shorter."""
        out = same.copy()
        for part in range(0, len(a), 8192):
            i = np.arange(int(same[part : part + 8192].max(initial=0)))
            x, y = a[part : part + 8192, None] + i, b[part : part + 8192, None] + i
            end = len(self.bytes) - 1
            differ = (self.bytes[np.minimum(x, end)] != self.bytes[np.minimum(y, end)]) & (i < same[part : part + 8192, None])
            hit = differ.any(axis=1)
            if hit.any():
                out[part : part + 8192][hit] = differ[hit].argmax(axis=1)
        return out


def _runs(mask: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of True that stay within one segment."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = mask & np.concatenate(([True], ~mask[:-1] | (segment[1:] != segment[:-1])))
    at = np.flatnonzero(begin)
    return at, np.diff(np.append(np.cumsum(mask)[at] - 1, mask.sum()))


def _windows(c: dict[str, np.ndarray], stretch: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of all windows of these stretches: row, place in the row's stretch, and whether an equal one starts
    earlier in another of the rows. Rows are sorted by `rank` (the seed); only windows at one distance from
    the same seed can be equal.

    What stands left of the seed (read backwards) and right of it are two suffix sorts. At a depth d, runs of
    the order whose common prefixes reach d are classes of strings that agree on d bytes; two windows are
    equal where the classes on both sides are, at the depths that the window spans.
    """
    put = np.lexsort((c["start"], c["doc_id"], c["rank"]))
    c = {k: v[put] for k, v in c.items()}
    stretch = [stretch[i] for i in put]
    data = np.frombuffer(b"".join(stretch), np.uint8)
    size = np.array([len(x) for x in stretch])
    base, lead, rank = np.cumsum(size) - size, c["lead"], c["rank"]
    row = np.repeat(np.arange(len(size)), c["count"])
    k = np.arange(len(row)) - np.repeat(np.cumsum(c["count"]) - c["count"], c["count"])
    left, depths = lead[row] - k, length - seed + 1
    classes = []
    for text, start, n, reach in ((data[::-1], len(data) - base - lead, lead, 0), (data, base + lead, size - lead, seed)):
        order, prefix = Suffixes(text).sort(start, n, rank)
        of = np.empty((depths, len(size)), np.int64)
        of[:, order] = np.cumsum(prefix[None] < np.arange(reach, reach + depths)[:, None], axis=1)
        classes.append(of)
    key = (classes[0][left, row] << 32 | classes[1][length - left - seed, row]) * 128 + left
    order = np.argsort(key, kind="stable")
    late = np.zeros(len(row), bool)
    late[order[1:]] = key[order[1:]] == key[order[:-1]]
    return put[row], k, late


def _leads(stretch: list[bytes], length: int, seed: int) -> np.ndarray:
    """For each stretch, the place of the leftmost smallest seed hash in its first window."""
    if not stretch:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(x[:length] for x in stretch), np.uint8)
    s, (_, down) = prefix_hashes(data), powers(len(data))
    begin = (np.arange(len(stretch)) * length)[:, None] + np.arange(length - seed + 1)
    grams = mix(_range_hash(s, down, begin, begin + seed)) & ~np.uint64((1 << 24) - 1)
    return grams.argmin(axis=1)


def halves(lead: int, count: int, low: int, high: int, stretch: bytes, length: int = LENGTH, seed: int = SEED) -> list[tuple]:
    """A stretch whose seed stands at `lead`, cut in two by where the seed stands in its windows: `low` to the
    middle, and from there to `high` bytes before it. Each part: the bytes that all windows of such a part
    share by where they stand around the seed, first window, count, lead, low, high, and the part's bytes."""
    middle, out = (low + high) // 2, []
    for lo, hi in ((low, middle), (middle + 1, high)):
        a, b = max(lo, lead - count + 1), min(hi, lead)
        if a <= b:
            k, n = lead - b, b - a + 1
            out.append((stretch[lead - lo : lead + length - hi], k, n, b, lo, hi, stretch[k : k + n - 1 + length]))
    return out


_PLACE = ["doc_id", "twin", "start"]
_HEAD = "g long, f long, doc_id long, twin long, start long, count int, lead int, low int, high int, bytes binary"


def twin(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: 0 where no doc_id has two different texts, else a hash of the text."""
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"))
    one = ids.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty()
    return F.lit(0).cast("long") if one else F.xxhash64(F.col("text").cast("string"))


def repeated_windows(docs: DataFrame, own: Column, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, twin (the value of `own`), start, count: runs of windows of `length` bytes whose bytes also start
    earlier in the corpus.

    Segments (see `segments`) are grouped by seed; seeds met once go. Stretches that are wholly equal keep
    their earliest place, and the others repeat as a whole. Around seeds with several different stretches the
    earliest place of each is fetched with its bytes and suffix-sorted, group by group. A group larger than
    GROUP is split first: each stretch into two (see `halves`), which are grouped anew by the bytes around the
    seed that all windows of such a part share, wholly equal parts again keep their earliest place, and so
    on while a group is too large. That ends with parts of one window, which are equal within a group. So a
    stretch makes two rows a round at most, and no task holds more than a group.
    """
    seed_of = "seed long, stretch long, doc_id long, twin long, start long, count int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch):
                text, start, count, h, stretch = segments(texts, length, seed)
                ids, twins = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "twin"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids[text]), pa.array(twins[text]), pa.array(start), pa.array(count.astype(np.int32))], ["seed", "stretch", "doc_id", "twin", "start", "count"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    cuts = read.withColumn("twin", own).mapInArrow(released(cut), seed_of)
    seeds = cuts.groupBy("seed").agg(F.count("*").alias("n"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("n > 1").selectExpr("seed", "lo <> hi AS mixed")
    seeds = written(seeds, "seeds")
    met = written(cuts.join(seeds, "seed"), "met")
    place = F.struct(*_PLACE)
    heads = met.groupBy("seed", "stretch").agg(F.min(place).alias("p"), F.first("count").alias("count"), F.first("mixed").alias("mixed")).selectExpr("seed", "p.doc_id", "p.twin", "p.start", "count", "mixed")
    heads = written(heads, "heads")
    late = [met.join(heads.select(*_PLACE), _PLACE, "left_anti").select(*_PLACE, "count")]

    mixed = heads.where("mixed")
    crowds = written(mixed.groupBy("seed").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")
    mixed = written(mixed.join(crowds, "seed"), "mixed")
    asked = mixed.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("seed", "start", "count", "crowd")).alias("ask"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, own_twin, text, ask in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "twin", "text", "ask")), strict=True):
                data = text.encode()
                rows += [(x["seed"], 0, doc, own_twin, x["start"], x["count"], data[x["start"] : x["start"] + x["count"] - 1 + length], x["crowd"]) for x in ask]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            for i in range(0, len(rows), 4096):
                cols = list(zip(*rows[i : i + 4096], strict=True))
                n, lead = len(cols[0]), _leads(list(cols[6]), length, seed)
                a = [pa.array(x, t) for x, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*a[:6], pa.array(lead.astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, length - seed, np.int32)), *a[6:]], [*(x.split()[0] for x in _HEAD.split(", ")), "crowd"])

    texts = thinned(read, asked.select("doc_id")).withColumn("twin", own)
    groups = written(texts.join(asked, ["doc_id", "twin"]).mapInArrow(released(fetch), f"{_HEAD}, crowd long"), "around")

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        c = {n: table.column(n).to_numpy().astype(np.int64) for n in ("g", "f", "doc_id", "twin", "start", "count", "lead")}
        order = np.lexsort((c["start"], c["twin"], c["doc_id"], c["f"], c["g"]))
        same = np.logical_and.reduce([c[n][order[1:]] == c[n][order[:-1]] for n in ("g", "f", *_PLACE)])
        order = order[np.concatenate(([True], ~same))]  # rows that repeat a document are that document
        c, stretch = {k: v[order] for k, v in c.items()}, table.column("bytes").take(order).to_pylist()
        turn = (c["g"][1:] != c["g"][:-1]) | (c["f"][1:] != c["f"][:-1])
        c["rank"] = np.concatenate(([0], np.cumsum(turn)))
        row, k, again = _windows(c, stretch, length, seed)
        at, n = _runs(again, row)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["doc_id"][row[at]], c["twin"][row[at]], c["start"][row[at]] + k[at], n.astype(np.int32))], [*_PLACE, "count"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group by group, several at a time: runs of repeated windows."""
        held: list[pa.RecordBatch] = []
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(i, 2048)
                g, f = batch.column("g").to_numpy(), batch.column("f").to_numpy()
                turn = np.flatnonzero((g != g[-1]) | (f != f[-1]))
                cut_at = int(turn[-1]) + 1 if len(turn) else 0
                if cut_at or held and (held[-1].column("g")[0].as_py(), held[-1].column("f")[0].as_py()) != (g[0], f[0]):
                    if held or cut_at:
                        yield solved([*held, batch.slice(0, cut_at)])
                    held = []
                held.append(batch.slice(cut_at))
        if held:
            yield solved(held)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        for batch in sliced(batches, 2048):
            rows = []
            for doc, own_twin, start, count, lead, low, high, stretch in zip(*(batch.column(x).to_pylist() for x in (*_PLACE, "count", "lead", "low", "high", "bytes")), strict=True):
                for core, k, n, at, lo, hi, part in halves(lead, count, low, high, stretch, length, seed):
                    key = np.frombuffer(hashlib.blake2b(core + b"%d,%d" % (lo, hi), digest_size=16).digest(), np.int64).tolist()
                    same = np.frombuffer(hashlib.blake2b(part + b"%d" % at, digest_size=8).digest(), np.int64)[0]
                    rows.append((*key, doc, own_twin, start + k, n, at, lo, hi, part, same))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], [*(x.split()[0] for x in _HEAD.split(", ")), "same"])

    made = [seeds, met, heads, crowds, mixed]
    while True:
        fit = groups.where(f"crowd > 1 AND crowd <= {GROUP}").drop("crowd").repartition("g", "f").sortWithinPartitions("g", "f")
        runs = written(fit.mapInArrow(released(resolve), "doc_id long, twin long, start long, count int"), "windows")
        late.append(runs)
        made += [groups, runs]
        large = groups.where(f"crowd > {GROUP}")
        if large.isEmpty():
            break
        parts = written(large.drop("crowd").mapInArrow(released(split), f"{_HEAD}, same long"), "parts")
        first = written(parts.groupBy("g", "f", "same").agg(F.min(place).alias("p")).select("p.*"), "first")
        late.append(parts.join(first, _PLACE, "left_anti").select(*_PLACE, "count"))
        kept = written(parts.join(first, _PLACE, "left_semi").drop("same").dropDuplicates(_PLACE), "kept")
        crowd = written(kept.groupBy("g", "f").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowd")
        groups = written(kept.join(crowd, ["g", "f"]).select(*kept.columns, "crowd"), "groups")
        made += [parts, first, kept, crowd]
    out = written(reduce(DataFrame.unionByName, late), "repeats")
    dropped(*made)
    return out


def _spans(docs: DataFrame, own: Column, length: int) -> DataFrame:
    return repeated_windows(docs, own, length).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "count")).alias("found"))


def _covered(n: int, found: list | None, length: int) -> np.ndarray:
    """Which of n bytes the windows found cover."""
    edge = np.zeros(n + 1, np.int64)
    if found:
        begin = np.minimum(np.array([x["start"] for x in found]), n)
        np.add.at(edge, begin, 1)
        np.add.at(edge, np.minimum(begin + np.array([x["count"] for x in found]) - 1 + length, n), -1)
    return np.cumsum(edge)[:-1] > 0


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs`, all columns, with the repeated strings cut from text (and n_chars, where it is a column, made to
    fit). A character goes if all of its bytes do, so texts stay valid; a text that repeats as a whole stays
    as an empty one."""
    own = twin(docs)
    spans = written(_spans(docs, own, length), "spans")
    some, rest = parted(docs, spans.select("doc_id"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text and found:
                    data = np.frombuffer(text.encode(), np.uint8)
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.logical_and.reduceat(_covered(len(data), found, length), lead)
                    text = data[~np.repeat(gone, np.diff(np.append(lead, len(data))))].tobytes().decode()
                texts.append(text)
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    runs_of, twin_of = unused(names, "__found"), unused(names, "__twin")
    found = spans.withColumnsRenamed({"found": runs_of, "twin": twin_of})
    return some.withColumn(twin_of, own).join(found, ["doc_id", twin_of], "left").select(*names, runs_of).mapInArrow(released(run), docs.schema).unionByName(rest)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans (array of [begin, end)).

    Each text's UTF-8 bytes (null: empty) lose every byte that a string of `length` bytes covers which also
    starts earlier: in a smaller doc_id, or earlier in the same text. Strings are judged on the input and do
    not cross texts; shorter texts lose nothing. Rows without a doc_id are never earlier than others and lose
    nothing. Rows that repeat a doc_id with the same text are one document and lose the same; with different
    texts each is a document of its own, the earlier one being that of the smaller xxhash64. An empty table
    gives no rows.
    """
    own = twin(docs)
    spans = _spans(docs, own, length)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
                data = (text or "").encode()
                gone = _covered(len(data), found, length)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if found else data
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                rows.append((doc, len(data), len(data) - len(kept), len(turn) // 2, hashlib.sha256(kept).hexdigest(), kept, turn.reshape(-1, 2).tolist()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.withColumn("twin", own).join(spans, ["doc_id", "twin"], "left").mapInArrow(released(take), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
