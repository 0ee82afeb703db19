"""Benchmark decontamination by latent semantic retrieval (operator 2)."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import dropped, released, sliced, steps, words, written

#: Words of a passage; passages of the search start every half passage.
PASSAGE = 48
STEP = PASSAGE // 2
#: Rank of the latent space, dimensions beyond it while it is sought, and power iterations.
RANK, OVERSAMPLE, ROUNDS, SEED = 64, 16, 2, 11
#: The most frequent terms, whose products with passages are dense, and passages of one such product.
COMMON, ROWS = 512, 2048
#: Cosine in the latent space from which a passage and a piece of an item are a candidate.
COSINE = 0.6
#: Shares of an item's informative words, the rarer half of them, that its longest common subsequence with a passage's
#: surroundings must hold: alone; with a share of the answer, which is the item's last quarter; or, where the
#: words were put in another order, with so large a share of them in any order.
SURE, LIKELY, ANSWER, LOOSE, ANY_ORDER = 0.65, 0.5, 0.6, 0.4, 0.8
#: Share of a piece's informative words that a candidate passage must hold: a copy lies in two passages, one of
#: which holds half of what LIKELY asks for.
COVERED = LIKELY / 2
#: Items that are looked for in one run over the corpus; larger benchmarks take several.
ITEMS = 20_000
#: Terms of one part of a sum over tasks.
CHUNK = 512
_BREAK = np.array([not (chr(i).isalnum() and i < 128 or i >= 128) for i in range(256)])


@dataclass
class Items:
    """The benchmark: word hashes of its vocabulary, each item's words as places in it, and item ids."""

    vocabulary: np.ndarray
    terms: list[np.ndarray]
    ids: list[int]


def read_items(benchmark: DataFrame) -> Items:
    """The benchmark is a table of its own, of a size that doesn't follow the corpus; items without words go."""
    rows = [(r["item_id"], (r["text"] or "").encode()) for r in benchmark.select("item_id", F.lower("text").alias("text")).where("item_id IS NOT NULL").orderBy("item_id", "text").collect()]
    h, _, first = words([t for _, t in rows], _BREAK)
    vocabulary = np.unique(h)
    terms = [np.searchsorted(vocabulary, h[a:b]) for a, b in zip(first, first[1:], strict=False)]
    kept = [i for i, t in enumerate(terms) if len(t)]
    return Items(vocabulary, [terms[i] for i in kept], [rows[i][0] for i in kept])


def hits(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n_words, and places and terms of the words of the whole text that the vocabulary holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, texts in steps(batch):
                h, of, first = words(texts, _BREAK)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                met = np.flatnonzero(known[at] == h)
                place, term = (met - first[of[met]]).astype(np.int32), at[met].astype(np.int32)
                bounds = np.searchsorted(met, first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), *(pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()) for x in (place, term))], ["doc_id", "n_words", "place", "term"])

    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(released(run), "doc_id long, n_words long, place binary, term binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; text, place and term of each hit."""
    place, term = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("place", "term"))
    n = np.array([len(x.as_py()) // 4 for x in batch.column("term")], np.int64)
    return batch.column("n_words").to_numpy(), np.repeat(np.arange(len(n)), n), place.astype(np.int64), term


@dataclass
class Index:
    """The benchmark in the latent space: the basis (terms x rank), the direction of each piece of an item, its
    item, its distinct informative words one after the other (their ends), and which terms are such a word."""

    basis: np.ndarray
    directions: np.ndarray
    item: np.ndarray
    word: np.ndarray
    end: np.ndarray
    keyed: np.ndarray


def pieces(terms: list[np.ndarray], keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The items cut into pieces of a passage at most, with the item of each and its distinct informative words."""
    cut = [(i, part) for i, t in enumerate(terms) for part in np.array_split(t, -(-len(t) // PASSAGE))]
    return [part for _, part in cut], np.array([i for i, _ in cut]), [np.intersect1d(part, keys[i]) for i, part in cut]


def informative(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rarer half of an item's words, in order."""
    return terms[idf[terms] >= np.median(idf[terms])]


def passages(n_words: np.ndarray, of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half passages: text and first word of the passage that begins with each (all but a text's last one, if it has
    several), and the half that each hit is in."""
    halves = np.maximum(1, -(-n_words // STEP))
    base = np.concatenate(([0], np.cumsum(halves)))
    text = np.repeat(np.arange(len(n_words)), halves)
    return text, (np.arange(base[-1]) - base[text]) * STEP, base[of] + place // STEP


def candidates(n_words: np.ndarray, of: np.ndarray, place: np.ndarray, term: np.ndarray, idf: np.ndarray, x: Index, cosine: float = COSINE) -> tuple[np.ndarray, ...]:
    """Text, first word, item and cosine of passages and items near each other in the latent space, whose passage
    also holds the share COVERED of the informative words of the item's piece.

    A passage is two halves, its vector the sum of theirs. Passages with fewer informative words of any item than
    the smallest piece asks for can't hold that share and are not projected.
    """
    text, begin, half = passages(n_words, of, place)
    n, two = len(text), np.concatenate((text[1:] == text[:-1], [False])) if len(text) else np.zeros(0, bool)
    first = two | (begin == 0)
    least = max(1, int(np.ceil(COVERED * np.diff(x.end, prepend=0).min() - 1e-9)))
    held = np.unique(half[x.keyed[term]] * len(idf) + term[x.keyed[term]])
    some = np.bincount(held // len(idf), minlength=n)
    good = first & (some + np.where(two, np.append(some[1:], 0), 0) >= least)
    need = good | np.concatenate(([False], (good & two)[:-1])) if n else good
    rows, use = np.flatnonzero(need), need[half]
    h, t = half[use], term[use]
    z = np.zeros((n, x.basis.shape[1]), np.float32)
    if len(h):
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        z[h[starts]] = np.add.reduceat(x.basis[t] * idf[t, None].astype(np.float32), starts, axis=0)
    out: list[tuple] = []
    rows = rows[good[rows]]
    for at in range(0, len(rows), 8192):
        r = rows[at : at + 8192]
        own = z[r] + np.where(two[r, None], z[np.minimum(r + 1, n - 1)], 0)
        c = own @ x.directions / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        i, p = np.nonzero(c >= cosine)
        out.append((r[i], p, c[i, p]))
    w, p, c = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    share = covered(w, p, two, held, len(idf), x)
    keep = share >= COVERED - 1e-9
    w, p, c = w[keep], p[keep], c[keep]
    return text[w], begin[w], x.item[p], c


def covered(w: np.ndarray, p: np.ndarray, two: np.ndarray, held: np.ndarray, n_terms: int, x: Index) -> np.ndarray:
    """Of passages (by first half) and pieces, the share of the piece's informative words that the passage holds."""
    size = np.diff(x.end, prepend=0)
    out = np.zeros(len(w))
    for at in range(0, len(w), 1 << 16):
        a, b = w[at : at + (1 << 16)], p[at : at + (1 << 16)]
        n = size[b]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x.end[b] - n, n)
        own, t = np.repeat(a, n), x.word[place]
        met = _among(own * n_terms + t, held) | two[own] & _among((own + 1) * n_terms + t, held)
        out[at : at + (1 << 16)] = np.bincount(np.repeat(np.arange(len(a)), n), met, len(a)) / np.maximum(n, 1)
    return out


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x if len(held) else np.zeros(len(x), bool)


def inverse_frequencies(found: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """idf of each term of the vocabulary over all passages of all texts, and the number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(terms, np.int64), 0
        for batch in sliced(batches):
            n_words, of, place, term = _unpacked(batch)
            held = -(-n_words // PASSAGE)
            n += int(held.sum())
            base = np.concatenate(([0], np.cumsum(held)))
            df += np.bincount(np.unique((base[of] + place // PASSAGE) * terms + term) % terms, minlength=terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, terms)), pa.array(np.append(n, df))], ["t", "n"])

    total = np.zeros(terms + 1)
    for r in found.mapInArrow(released(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        total[r["t"] + 1] = r["n"]
    return np.log((total[0] + 1) / (total[1:] + 1)) + 1, int(total[0])


def _weighed(row: np.ndarray, t: np.ndarray, idf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and weights of a sparse matrix of rows of norm 1, in order, a term weighing its count times its idf."""
    pair, count = np.unique(row * len(idf) + t, return_counts=True)
    row, t = pair // len(idf), pair % len(idf)
    v = count * idf[t]
    v /= np.sqrt(np.bincount(row, v**2, rows))[row]
    return row, t, v


def _rows(sets: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of terms as a sparse matrix: row bounds, terms and weights. Empty lists are left out."""
    sets = [x for x in sets if len(x)]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    row, t, v = _weighed(row, np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64), idf, len(sets))
    return np.searchsorted(row, np.arange(len(sets) + 1)), t, v


def _times(m: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray) -> np.ndarray:
    bounds, t, v = m
    return np.add.reduceat(v[:, None] * dense[t], bounds[:-1], axis=0) if len(t) else np.zeros((0, dense.shape[1]))


def _transposed_times(m: tuple[np.ndarray, np.ndarray, np.ndarray], z: np.ndarray, n_terms: int) -> np.ndarray:
    bounds, t, v = m
    out = np.zeros((n_terms, z.shape[1]))
    if len(t):
        row, put = np.repeat(np.arange(len(z)), np.diff(bounds)), np.argsort(t, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(t[put]) > 0)))
        out[t[put][start]] = np.add.reduceat(v[put][:, None] * z[row[put]], start, axis=0)
    return out


def summed(parts: DataFrame, width: int, rows: int) -> np.ndarray:
    """The sum of (chunk, part, data) matrices, chunks of CHUNK rows: first of a few tasks each, then of all."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("data").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "data": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    schema = "chunk long, part int, data binary"
    some = parts.withColumn("part", F.pmod("part", F.lit(32))).groupBy("chunk", "part").applyInArrow(add, schema)
    out = np.zeros((-(-rows // CHUNK) * CHUNK, width))
    for r in some.groupBy("chunk").applyInArrow(add, schema).collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], "<f4").reshape(CHUNK, width)
    return out[:rows]


class Products:
    """Adds up A'(A x) for rows of A that come in portions: frequent terms as dense columns, the others as they are."""

    def __init__(self, dense: np.ndarray, idf: np.ndarray):
        self.dense, self.common = dense, np.argsort(idf, kind="stable")[:COMMON]
        self.slot = np.full(len(idf), -1)
        self.slot[self.common] = np.arange(len(self.common))
        self.total, self.often = np.zeros(dense.shape), np.zeros((len(self.common), dense.shape[1]))

    def add(self, row: np.ndarray, t: np.ndarray, v: np.ndarray, rows: int) -> None:
        v = v.astype(np.float32)
        bounds = np.searchsorted(row, np.arange(0, rows + ROWS, ROWS))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                self._add(row[a:b] - i * ROWS, t[a:b], v[a:b], min(ROWS, rows - i * ROWS))

    def _add(self, row: np.ndarray, t: np.ndarray, v: np.ndarray, rows: int) -> None:
        slot = self.slot[t]
        often = slot >= 0
        held = np.zeros((rows, len(self.common)), np.float32)
        held[row[often], slot[often]] = v[often]
        z = held @ self.dense[self.common]
        row, t, v = row[~often], t[~often], v[~often, None]
        if len(row):
            start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            z[row[start]] += np.add.reduceat(v * self.dense[t], start, axis=0)
            put = np.argsort(t, kind="stable")
            start = np.flatnonzero(np.append(True, np.diff(t[put]) > 0))
            self.total[t[put][start]] += np.add.reduceat(v[put] * z[row[put]], start, axis=0)
        self.often += held.T @ z

    def result(self) -> np.ndarray:
        out = self.total.copy()
        out[self.common] += self.often
        return out


def latent_basis(found: DataFrame, own: tuple, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (terms x rank) and singular values of the TF-IDF matrix of all passages.

    Randomised SVD: a random basis is multiplied by A'A, whose products with the passages all tasks add up, and
    orthonormalised, ROUNDS times; from one more product Y of the basis B the vectors follow by Nystroem's
    formula, A'A being about Y (B'Y)^-1 Y'. A has every passage of the corpus, and the pieces of the
    benchmark's items (`own`), weighing as much in all as the corpus does, as what is rare in the corpus but the
    benchmark's must have its place in the space. The rank follows neither the items nor the corpus.
    """
    spark, n, width = found.sparkSession, len(idf), min(len(idf), rank + OVERSAMPLE)

    def total(dense: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((dense.astype(np.float32), idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, weights = shared.value
            products = Products(basis, weights)
            for batch in sliced(batches):
                n_words, of, place, term = _unpacked(batch)
                base = np.concatenate(([0], np.cumsum(-(-n_words // PASSAGE))))
                products.add(*_weighed(base[of] + place // PASSAGE, term, weights, int(base[-1])), int(base[-1]))
            out, own_part = products.result(), zlib.crc32(uuid.uuid4().bytes) & 0x7FFFFFFF
            chunks = [(i // CHUNK, out[i : i + CHUNK]) for i in range(0, len(out), CHUNK) if out[i : i + CHUNK].any()]
            data = [np.concatenate((c, np.zeros((CHUNK - len(c), c.shape[1])))).astype("<f4").tobytes() for _, c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks], pa.int64()), pa.array([own_part] * len(chunks), pa.int32()), pa.array(data, pa.binary())], ["chunk", "part", "data"])

        return summed(found.mapInArrow(released(run), "chunk long, part int, data binary"), dense.shape[1], n)

    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, width)))[0]
    for i in range(ROUNDS + 1):
        y, z = total(basis), _transposed_times(own, _times(own, basis), n)
        y += max(1.0, np.linalg.norm(y) / max(np.linalg.norm(z), 1e-9)) * z
        if i < ROUNDS:
            basis = np.linalg.qr(y)[0]
    core = basis.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    held = values > 1e-6 * max(values.max(initial=0), 1e-9)
    vectors, values, _ = np.linalg.svd(y @ turn[:, held] / np.sqrt(values[held]), full_matrices=False)
    return vectors[:, :rank], values[:rank]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table being the bits of one integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, mask = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        u = row & at.get(x, 0)
        row = (row + u | row - u) & mask
    return len(a) - row.bit_count()


def verified(item: np.ndarray, key: np.ndarray, near: list[int]) -> tuple[int, float, float] | None:
    """Common subsequence of an item's informative words with these, its share of them, and the share of the answer;
    None where they don't hold the item."""
    n = lcs(key.tolist(), near)
    share = n / len(key)
    if share < LOOSE:
        return None
    tail = item[-max(3, len(item) // 4) :]
    answer = lcs(tail.tolist(), near) / len(tail)
    if share >= SURE or share >= LIKELY and answer >= ANSWER:
        return n, share, answer
    if sum((Counter(key.tolist()) & Counter(near)).values()) >= ANY_ORDER * len(key):
        return n, share, answer
    return None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, share, answer_share: each document with each benchmark item it holds.

    All words of all texts are read, and the latent space is fitted on all of their passages. A passage is a candidate for an item if its cosine with a piece of the item in
    the latent space reaches COSINE and it holds the share COVERED of that piece's informative words. It is then
    compared word by word with the item: see `verified`, for the passage's surroundings as far as the item is
    long. The benchmark's words, the basis (RANK numbers a word) and the pieces' directions go to all tasks, of
    ITEMS items at most; a larger benchmark is looked for in several runs. Null or empty texts and items match
    nothing, nor do rows without a doc_id or item_id; repeated doc_ids and item_ids come out once; an empty
    benchmark gives no rows.
    """
    runs = -(-benchmark.where("item_id IS NOT NULL").count() // ITEMS)
    parts = [_found(docs, benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(runs)) == i) if runs > 1 else benchmark) for i in range(runs)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _SCHEMA)


_SCHEMA = "doc_id long, item_id long, cosine double, lcs int, share double, answer_share double"


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark, items = docs.sparkSession, read_items(benchmark)
    if not items.ids:
        return spark.createDataFrame([], _SCHEMA)
    found = written(hits(docs.where("doc_id IS NOT NULL"), items.vocabulary), "hits")
    idf, _ = inverse_frequencies(found, len(items.vocabulary))
    keys = [informative(t, idf) for t in items.terms]
    cut, item, sets = pieces(items.terms, keys)
    kept = [i for i, x in enumerate(sets) if len(x)]
    cut, item, sets = [cut[i] for i in kept], item[kept], [sets[i] for i in kept]
    own = _rows(cut, idf)
    basis, _ = latent_basis(found, own, idf)
    directions = _times(own, basis)
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-9)
    keyed = np.zeros(len(idf), bool)
    keyed[np.concatenate(sets)] = True
    index = Index(basis.astype(np.float32), directions.T.astype(np.float32), item, np.concatenate(sets), np.cumsum([len(x) for x in sets]), keyed)
    shared = spark.sparkContext.broadcast((idf, index, keys, items.terms, items.ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, x, keys, terms, item_ids = shared.value
        for batch in sliced(batches):
            n_words, of, place, term = _unpacked(batch)
            best: dict[tuple[int, int], tuple] = {}
            first = np.searchsorted(of, np.arange(len(n_words) + 1))
            for d, begin, i, c in zip(*(v.tolist() for v in candidates(n_words, of, place, term, weights, x)), strict=True):
                reach = len(terms[i])
                a, b = first[d] + np.searchsorted(place[first[d] : first[d + 1]], [begin - reach, begin + PASSAGE + reach])
                got = verified(terms[i], keys[i], term[a:b].tolist())
                if got:
                    n, share, answer = got
                    best[d, i] = max(best.get((d, i), ()), (share, answer, c, n))
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[d], item_ids[i], c, n, s, a) for (d, i), (s, a, c, n) in sorted(best.items())]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "share", "answer_share"])

    best = F.max(F.struct("share", "answer_share", "cosine", "lcs")).alias("b")
    out = found.mapInArrow(released(run), _SCHEMA).groupBy("doc_id", "item_id").agg(best)
    out = written(out.select("doc_id", "item_id", "b.cosine", "b.lcs", "b.share", "b.answer_share"), "contaminated")
    dropped(found)
    return out
