"""Containers: a header, a schema, block records by row group and column, and an index with statistics."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from blockweave.errors import BlockError, CorruptError, DTypeError, VersionError
from blockweave.sources.record import Record, decode_block, encode_block, read_record
from blockweave.spec import CodecSpec
from blockweave.types import Block, DType, Layout, from_ordered, to_ordered

# The magic number of container files, header, flags and entry sizes.
MAGIC = 0x31434454
HEADER = struct.Struct("<IHHQQQBBBBI3Q")
HETEROGENEOUS, HAS_STATS = 1, 2
STATS = struct.Struct("<B16s16sQ")
GROUP = struct.Struct("<QQHHI")
PREFIX = 8


@dataclass(frozen=True)
class Column:
    name: str
    dtype: DType
    annotation: str = ""


@dataclass(frozen=True)
class Stats:
    """Smallest and largest value as 16 bytes (strings: a prefix of 8), and the number of nulls."""

    low: bytes = bytes(16)
    high: bytes = bytes(16)
    nulls: int = 0
    known: bool = True

    def values(self, dtype: DType):
        if not self.known:
            return None, None
        if dtype.is_variable:
            return self.low[:PREFIX].rstrip(b"\0"), self.high[:PREFIX].rstrip(b"\0")
        return tuple(np.frombuffer(x, dtype.numpy, 1)[0].item() for x in (self.low, self.high))


def compute_stats(block: Block) -> Stats:
    """Over the elements that are present. Floats are in the total order of their bits: -0.0 is below 0.0 and
    NaNs lie beyond the infinities."""
    valid = block.validity
    nulls = 0 if valid is None else int((~np.asarray(valid, bool)).sum())
    data = block.data
    if valid is not None:
        data = [x for x, ok in zip(data, valid, strict=True) if ok] if block.dtype.is_variable else data[np.asarray(valid, bool)]
    if not len(data):
        return Stats(nulls=nulls, known=False)
    if block.dtype.is_variable:
        return Stats(min(data)[:PREFIX].ljust(16, b"\0"), max(data)[:PREFIX].ljust(16, b"\0"), nulls)
    if block.dtype.is_float:
        u = to_ordered(data)
        low, high = (from_ordered(np.array([x]), data.dtype).tobytes() for x in (u.min(), u.max()))
    else:
        low, high = (np.array([x], data.dtype).tobytes() for x in (data.min(), data.max()))
    return Stats(low.ljust(16, b"\0"), high.ljust(16, b"\0"), nulls)


@dataclass
class Group:
    rows: int
    blocks: list[tuple[int, int]]
    stats: list[Stats] | None = None


def pack_schema(columns: list[Column]) -> bytes:
    out = struct.pack("<H", len(columns))
    for c in columns:
        for text, kind in ((c.name, True), (c.annotation, False)):
            raw = text.encode()
            if len(raw) > 0xFFFF:
                raise BlockError("name too long")
            out += struct.pack("<H", len(raw)) + raw + (bytes([c.dtype]) if kind else b"")
    return out


def unpack_schema(data: bytes) -> list[Column]:
    def text(at: int) -> tuple[str, int]:
        if at + 2 > len(data):
            raise CorruptError("schema")
        n = struct.unpack_from("<H", data, at)[0]
        if at + 2 + n > len(data):
            raise CorruptError("schema")
        return data[at + 2 : at + 2 + n].decode(errors="replace"), at + 2 + n

    if len(data) < 2:
        raise CorruptError("schema")
    out, at = [], 2
    for _ in range(struct.unpack_from("<H", data)[0]):
        name, at = text(at)
        if at >= len(data) or data[at] not in iter(DType):
            raise CorruptError("schema")
        kind = DType(data[at])
        note, at = text(at + 1)
        out.append(Column(name, kind, note))
    if at != len(data):
        raise CorruptError("schema")
    return out


def pack_index(groups: list[Group]) -> bytes:
    out = struct.pack("<Q", len(groups))
    for g in groups:
        stats = b"".join(STATS.pack(s.known, s.low, s.high, s.nulls) for s in g.stats) if g.stats else b""
        out += GROUP.pack(g.blocks[0][0], g.rows, len(g.blocks), 0, len(stats)) + b"".join(struct.pack("<QQ", *b) for b in g.blocks) + stats
    return out


def unpack_index(data: bytes) -> list[Group]:
    if len(data) < 8:
        raise CorruptError("index")
    out, at = [], 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        if at + GROUP.size > len(data):
            raise CorruptError("index")
        offset, rows, n, pad, size = GROUP.unpack_from(data, at)
        at += GROUP.size
        if pad or at + 16 * n + size > len(data) or size not in (0, n * STATS.size):
            raise CorruptError("index")
        blocks = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(n)]
        at += 16 * n
        if not n or blocks[0][0] != offset:
            raise CorruptError("index")
        stats = [Stats(low, high, nulls, bool(known)) for known, low, high, nulls in STATS.iter_unpack(data[at : at + size])] or None
        out.append(Group(rows, blocks, stats))
        at += size
    if at != len(data):
        raise CorruptError("index")
    return out


@dataclass
class Writer:
    """Blocks in row groups, to any seekable file. Nothing is a container until close()."""

    file: BinaryIO
    columns: list[Column] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    open_blocks: list[tuple[int, int]] = field(default_factory=list)
    stats: list[Stats] | None = None
    block_count: int = 0
    ended: bool = False

    def __post_init__(self):
        self._schema = pack_schema(self.columns) if self.columns else b""
        self.file.write(bytes(HEADER.size) + self._schema)
        self._at = HEADER.size + len(self._schema)

    def write_block(self, block: Block, spec: CodecSpec | None = None) -> None:
        if self.ended:
            raise BlockError("closed")
        if self.columns:
            i = len(self.open_blocks)
            if i >= len(self.columns):
                raise BlockError("more blocks than columns")
            if block.dtype is not self.columns[i].dtype:
                raise DTypeError(f"{self.columns[i].name} is {self.columns[i].dtype.name}")
        data = encode_block(block, spec)
        self.file.write(data)
        self.open_blocks.append((self._at, len(data)))
        self._at += len(data)
        self.block_count += 1

    def set_stats(self, stats: list[Stats]) -> None:
        if self.stats is not None or len(stats) != len(self.open_blocks):
            raise BlockError("statistics: once a row group, one a column")
        self.stats = list(stats)

    def end_group(self, rows: int) -> None:
        if not self.open_blocks or self.columns and len(self.open_blocks) != len(self.columns):
            raise BlockError("a row group has a block a column")
        self.groups.append(Group(rows, self.open_blocks, self.stats))
        self.open_blocks, self.stats = [], None

    def close(self) -> None:
        """Index, then the header, last."""
        if self.open_blocks:
            raise BlockError("blocks outside a row group")
        index = pack_index(self.groups)
        self.file.write(index)
        flags = HETEROGENEOUS | (HAS_STATS if any(g.stats for g in self.groups) else 0)
        self.file.seek(0)
        self.file.write(HEADER.pack(MAGIC, 1, flags, self.block_count, self._at, len(index), 0, 0, 0, 0, len(self._schema), 0, 0, 0))
        self.ended = True

    def abort(self) -> None:
        """Leaves what was written without a header, which no reader takes."""
        self.ended = True


class Reader:
    """Random access to any seekable file: schema, index, statistics and single blocks."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, io.SEEK_END)
        head = self._read(0, HEADER.size)
        magic, version, flags, blocks, index_at, index_size, dtype, layout, rank, zero, schema_size, a, b, c = HEADER.unpack(head)
        if magic != MAGIC:
            raise CorruptError("not a container")
        if version not in (1, 2):
            raise VersionError(f"container version {version}")
        if zero or flags & ~3 or rank > 3 or not flags & HETEROGENEOUS and dtype not in (0, *DType):
            raise CorruptError("container header")
        self.version, self.flags, self.block_count, self.index_at, self.index_size = version, flags, blocks, index_at, index_size
        self.schema_at, self.blocks_at = (a, b) if version == 2 else (HEADER.size, HEADER.size + schema_size)
        self.schema_size = schema_size
        self.schema = unpack_schema(self._read(self.schema_at, schema_size)) if schema_size else []
        self.groups = unpack_index(self._read(index_at, index_size)) if index_at else []
        self.has_index = bool(index_at)
        if self.schema and any(len(g.blocks) != len(self.schema) for g in self.groups):
            raise CorruptError("columns of a row group")

    def _read(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise CorruptError("end of file")
        self.file.seek(at)
        return self.file.read(n)

    def stats(self, group: int, column: int) -> Stats:
        g = self.groups[group]
        return g.stats[column] if g.stats else Stats(known=False)

    def record(self, group: int, column: int) -> Record:
        at, n = self.groups[group].blocks[column]
        return read_record(self._read(at, n))

    def block(self, group: int, column: int) -> Block:
        """Reads and decodes one column of one row group, and nothing else."""
        return decode_block(self.record(group, column))

    def blocks(self) -> Iterator[Record]:
        """All records in file order; only containers that were never widened have one."""
        if self.version != 1:
            raise BlockError("a widened container has random access only")
        data, at = self._read(self.blocks_at, (self.index_at or self.size) - self.blocks_at), 0
        while at < len(data):
            r = read_record(data, at)
            at += r.size
            yield r

    def project(self, columns: list[str] | None = None, ranges: dict[str, tuple] | None = None) -> Iterator[tuple[int, dict[str, Block]]]:
        """Row groups whose statistics allow all ranges (name -> low, high), with the wanted columns only."""
        names = [c.name for c in self.schema]
        for g in range(len(self.groups)):
            if all(may_hold(self.stats(g, names.index(n)), self.schema[names.index(n)].dtype, *r) for n, r in (ranges or {}).items()):
                yield g, {n: self.block(g, names.index(n)) for n in columns or names}


def may_hold(stats: Stats, dtype: DType, low, high) -> bool:
    """Whether a row group may have a value between two (either may be None). A string's stored maximum is a
    prefix, so only prefixes are compared with it."""
    lo, hi = stats.values(dtype)
    if lo is None:
        return True
    if dtype.is_variable:
        low, high = (x.encode() if isinstance(x, str) else x for x in (low, high))
        return not (low is not None and low[:PREFIX] > hi or high is not None and high < lo)
    if dtype.is_float and (hi != hi or lo != lo):
        return True
    return not (low is not None and hi < low or high is not None and lo > high)


def widen(file: BinaryIO, columns: list[Column], groups: list[list[tuple[Block, CodecSpec | None]]], with_stats: bool = True) -> None:
    """Appends columns to every row group of a container, in place: new blocks, schema and index go after the
    old end and the header is patched last, so a reader sees all of it or the container as it was."""
    old = Reader(file)
    if not old.has_index or not old.flags & HETEROGENEOUS or len(groups) != len(old.groups) or not columns:
        raise BlockError("widening needs an index and a block a column for each row group")
    if {c.name for c in columns} & {c.name for c in old.schema}:
        raise BlockError("such a column is there")
    at, count = file.seek(0, io.SEEK_END), old.block_count
    new = []
    for g, blocks in zip(old.groups, groups, strict=True):
        if len(blocks) != len(columns):
            raise BlockError("a block a column")
        places, stats = list(g.blocks), list(g.stats) if g.stats else [Stats(known=False)] * len(g.blocks)
        for c, (block, spec) in zip(columns, blocks, strict=True):
            if block.dtype is not c.dtype or block.shape[0] != g.rows and block.layout is Layout.VECTOR_1D:
                raise DTypeError(f"{c.name}: type or rows differ")
            data = encode_block(block, spec)
            file.write(data)
            places.append((at, len(data)))
            stats.append(compute_stats(block) if with_stats else Stats(known=False))
            at, count = at + len(data), count + 1
        new.append(Group(g.rows, places, stats if any(s.known for s in stats) else None))
    schema, index = pack_schema([*old.schema, *columns]), pack_index(new)
    file.write(schema + index)
    file.flush()
    file.seek(0)
    flags = HETEROGENEOUS | (HAS_STATS if any(g.stats for g in new) else 0)
    file.write(HEADER.pack(MAGIC, 2, flags, count, at + len(schema), len(index), 0, 0, 0, 0, len(schema), at, old.blocks_at, 0))


def inspect(file: BinaryIO) -> list[dict]:
    """One row a block: where it is, what it is and how it was encoded."""
    r = Reader(file)
    out = []
    for g, group in enumerate(r.groups):
        for c, (at, n) in enumerate(group.blocks):
            rec = r.record(g, c)
            low, high = r.stats(g, c).values(rec.dtype)
            out.append({"group": g, "column": c, "name": r.schema[c].name if r.schema else None, "dtype": rec.dtype.name, "layout": rec.layout.name, "shape": list(rec.shape), "model": rec.model, "transforms": list(rec.transforms), "entropies": list(rec.entropies), "offset": at, "bytes": n, "uncompressed": rec.uncompressed, "low": None if low is None else str(low), "high": None if high is None else str(high), "nulls": r.stats(g, c).nulls})
    return out
