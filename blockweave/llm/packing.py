"""Minimum-bin-slack packing of token pieces (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import released, written
from blockweave.llm.tokens import VOCABULARY, token_pieces

#: Pieces that one numbering task of a length holds, about.
RANK_ROWS = 4096


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum that is not above `room`.

    Subset sums are bits of one integer, copies of a length enter in powers of two, and the search ends as
    soon as the room is filled exactly.
    """
    reach, mask, taken = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1]:
        length = int(length)
        left, part = min(int(counts[length]), room // length) if length else 0, 1
        while left > 0:
            part = min(part, left)
            grown = reach | (reach << (part * length)) & mask
            if grown != reach:
                taken.append((length, part, reach))
                reach = grown
            left, part = left - part, part * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, part, before in reversed(taken):
        if not before >> at & 1:
            at -= part * length
            found[length] = found.get(length, 0) + part
    return found


def plan(counts: np.ndarray, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, last rank + 1, pieces a bin, first bin, first offset).

    Each bin starts with the longest length left and takes the fullest combination of the others; the
    combination is removed as often as the counts allow. The work and the plan depend on the number of
    distinct lengths, not on the number of pieces.
    """
    left, used, bins, out = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), 0, []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        mixture = fullest(left, size - longest)
        left[longest] += 1
        mixture[longest] = mixture.get(longest, 0) + 1
        times, offset = min(int(left[n]) // k for n, k in mixture.items()), 0
        for n, k in sorted(mixture.items(), reverse=True):
            out.append((n, int(used[n]), int(used[n]) + times * k, k, bins, offset))
            used[n] += times * k
            left[n] -= times * k
            offset += n * k
        bins += times
    return out


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths (`size` rows at most) reaches the driver, and the plan made from it goes
    back; pieces are numbered within their length in salted groups, dealt by the row and not by its id, so that a
    hot length, id or text is spread. Null or
    empty texts are one piece of the end id; an empty table gives none; repeated doc_ids keep all rows.
    """
    pieces = written(token_pieces(docs, size, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    salts = F.array(*(F.lit(int(max(1, -(-n // RANK_ROWS)))) for n in counts))
    segments = np.array(plan(counts, size), np.int64).reshape(-1, 6)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    keys = segments[:, 0] << 40 | segments[:, 1]

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.get(salts, F.col("length").cast("int"))))
    base = salted.groupBy("length", "salt").count().selectExpr("length", "salt", "coalesce(sum(count) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    ranked = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY row) - 1 AS r").join(base, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seg = segments[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            at = rank - seg[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seg[:, 4] + at // np.maximum(seg[:, 3], 1)), pa.array(seg[:, 5] + at % np.maximum(seg[:, 3], 1) * length)], [*names, "sequence_id", "offset"])

    return ranked.selectExpr(*names, "base + r AS rank").mapInArrow(released(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
