"""Block tables: one row a block, encoded and decoded in Arrow batches on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockweave import registry
from blockweave.errors import OK, BlockError, DTypeError, message
from blockweave.sources.record import decode_block, decode_dictionary, encode_block, peek, read_record
from blockweave.spec import CodecSpec
from blockweave.types import Block, DType, Layout, dtype_of

SCHEMA = "blk long, n long, dtype int, layout int, shape array<long>, model int, transforms array<int>, entropies array<int>, flags int, raw_bytes long, record binary"


def to_block(values: pa.ChunkedArray | pa.Array, dtype: DType, layout: Layout, shape: tuple[int, ...]) -> Block:
    """Values of a column as a block; nulls get a filler and a validity bitmap."""
    valid = None if not values.null_count else np.array(values.is_valid())
    if dtype.is_variable:
        data: list | np.ndarray = [x.encode() if isinstance(x, str) else bytes(x or b"") for x in (v or b"" for v in values.to_pylist())]
    else:
        flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        if pa.types.is_timestamp(flat.type):
            flat = flat.cast(pa.timestamp("us")).cast(pa.int64())
        data = flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
        data = data.astype(dtype.numpy, copy=False)
    return Block(data, dtype, layout, shape, valid)


def encode(df: DataFrame, spec: CodecSpec, order: tuple[str, ...] = ("i",), value: str = "v", layout: Layout = Layout.VECTOR_1D, dtype: DType | None = None) -> DataFrame:
    """The block table of long-form rows: one group a block, which must fit a task; its extent along each order
    column is that column's largest value plus one. Cells that no row has are held as nulls."""
    kind = dtype or dtype_of(df.schema[value])
    plugins = registry.plugins()

    def run(table: pa.Table) -> pa.Table:
        registry.adopt(plugins)
        table = table.sort_by([(c, "ascending") for c in order])
        shape = tuple(int(pa.compute.max(table.column(c)).as_py()) + 1 for c in order)
        values = table.column(value)
        if table.num_rows != math.prod(shape):
            at = np.ravel_multi_index([table.column(c).to_numpy() for c in order], shape)
            if len(np.unique(at)) < len(at):
                raise BlockError("two rows of one cell")
            row_of = np.full(math.prod(shape), -1)
            row_of[at] = np.arange(len(at))
            values = values.combine_chunks().take(pa.array(row_of, mask=row_of < 0))
        block = to_block(values, kind, layout, shape)
        data = encode_block(block, spec)
        r = read_record(data)
        raw = sum(map(len, block.data)) if kind.is_variable else block.data.nbytes
        row = {"blk": table.column("blk")[0].as_py(), "n": block.count, "dtype": int(kind), "layout": int(layout), "shape": list(shape), "model": r.model, "transforms": list(r.transforms), "entropies": list(r.entropies), "flags": r.flags, "raw_bytes": raw, "record": data}
        return pa.Table.from_pylist([row], _ARROW)

    return df.select(F.col("blk").cast("bigint"), *order, value).groupBy("blk").applyInArrow(run, SCHEMA)


_ARROW = pa.schema([("blk", pa.int64()), ("n", pa.int64()), ("dtype", pa.int32()), ("layout", pa.int32()), ("shape", pa.list_(pa.int64())), ("model", pa.int32()), ("transforms", pa.list_(pa.int32())), ("entropies", pa.list_(pa.int32())), ("flags", pa.int32()), ("raw_bytes", pa.int64()), ("record", pa.binary())])


def from_block(block: Block) -> pa.Array:
    """A block's values as an Arrow array, nulls restored."""
    if block.dtype.is_variable:
        data = pa.array(list(block.data), pa.binary())
    else:
        x = block.data
        if block.dtype is DType.F16:
            x = x.astype(np.float32)
        if not block.dtype.is_signed:
            x = x.astype({1: np.int16, 2: np.int32, 4: np.int64, 8: np.int64}[block.dtype.size], casting="unsafe")
        data = pa.array(x)
    return data if block.validity is None else pa.compute.if_else(pa.array(block.validity), data, pa.scalar(None, data.type))


def decode(blocks: DataFrame, dtype: DType, order: tuple[str, ...] = ("i",)) -> DataFrame:
    """Long-form rows (blk, order columns, v) of a block table; no shuffle."""
    out = T.StructType([T.StructField("blk", T.LongType()), *(T.StructField(c, T.LongType()) for c in order), T.StructField("v", dtype.spark)])
    plugins = registry.plugins()

    def run(batches):
        registry.adopt(plugins)
        for batch in batches:
            for blk, record in zip(batch.column("blk").to_pylist(), batch.column("record").to_pylist(), strict=True):
                block = decode_block(record)
                if block.dtype is not dtype:
                    raise DTypeError(f"block {blk} is {block.dtype.name}")
                place = np.indices(block.shape).reshape(len(block.shape), -1) if block.count else np.zeros((len(block.shape), 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(block.count, blk)), *map(pa.array, place.astype(np.int64)), from_block(block)], ["blk", *order, "v"])

    return blocks.select("blk", "record").mapInArrow(run, out)


def map_bytes(df: DataFrame, column: str, f: Callable[[bytes], bytes]) -> DataFrame:
    """A byte kernel over a binary column, batch by batch."""
    plugins, names = registry.plugins(), df.columns

    def run(batches):
        registry.adopt(plugins)
        for batch in batches:
            done = pa.array([None if x is None else f(x) for x in batch.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([done if n == column else batch.column(n) for n in names], names)

    return df.mapInArrow(run, df.schema)


def bit_pattern(df: DataFrame, value: str = "v") -> DataFrame:
    """`bits`: the bits of a double column as a long; -0.0 and NaN payloads stay apart."""
    names = df.columns

    def run(batches):
        for batch in batches:
            x = batch.column(value)
            bits = pa.array(np.array(x.fill_null(0.0).to_numpy(zero_copy_only=False), np.float64).view(np.int64), mask=np.array(x.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], [*names, "bits"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("bits", T.LongType())]))


def from_bit_pattern(df: DataFrame) -> DataFrame:
    """`v`: doubles from `bits`."""
    names = [c for c in df.columns if c != "v"]

    def run(batches):
        for batch in batches:
            b = batch.column("bits")
            v = pa.array(np.array(b.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.float64), mask=np.array(b.is_null()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), v], [*names, "v"])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in names), T.StructField("v", T.DoubleType())]))


def checked(blocks: DataFrame, payload: bool = True) -> DataFrame:
    """blk, code and message of each record: the status that reading it (and, with `payload`, decoding it) ends
    with; a bad record is a row like any other."""
    plugins = registry.plugins()

    def run(batches):
        registry.adopt(plugins)
        for batch in batches:
            codes, said = [], []
            for record in batch.column("record").to_pylist():
                try:
                    decode_block(record) if payload else read_record(record)
                    codes.append(OK)
                    said.append(message(OK))
                except BlockError as e:
                    codes.append(e.code)
                    said.append(f"{message(e.code)}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array(codes, pa.int32()), pa.array(said, pa.string())], ["blk", "code", "message"])

    return blocks.select("blk", F.coalesce("record", F.lit(b"")).alias("record")).mapInArrow(run, "blk long, code int, message string")


def peeked(blocks: DataFrame) -> DataFrame:
    """blk, dtype, layout, shape and bytes of the elements (null for strings), from the headers alone."""

    def run(batches):
        for batch in batches:
            found = [peek(x) for x in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array([f["dtype"].name for f in found], pa.string()), pa.array([f["layout"].name for f in found], pa.string()), pa.array([list(f["shape"]) for f in found], pa.list_(pa.int64())), pa.array([f["bytes"] for f in found], pa.int64())], ["blk", "dtype", "layout", "shape", "bytes"])

    return blocks.select("blk", "record").mapInArrow(run, "blk long, dtype string, layout string, shape array<long>, bytes long")


def dictionaries(blocks: DataFrame) -> DataFrame:
    """blk, code and v (bytes) of the dictionaries of string blocks, their elements not decoded."""

    def run(batches):
        for batch in batches:
            for blk, record in zip(batch.column("blk").to_pylist(), batch.column("record").to_pylist(), strict=True):
                words, _ = decode_dictionary(record)
                yield pa.RecordBatch.from_arrays([pa.array([blk] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array(words, pa.binary())], ["blk", "code", "v"])

    return blocks.select("blk", "record").mapInArrow(run, "blk long, code long, v binary")


def dictionary_indices(blocks: DataFrame) -> DataFrame:
    """blk, i and code of string blocks: to be joined with what a predicate leaves of dictionaries()."""

    def run(batches):
        for batch in batches:
            for blk, record in zip(batch.column("blk").to_pylist(), batch.column("record").to_pylist(), strict=True):
                _, codes = decode_dictionary(record)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), blk)), pa.array(np.arange(len(codes))), pa.array(codes.astype(np.int64))], ["blk", "i", "code"])

    return blocks.select("blk", "record").mapInArrow(run, "blk long, i long, code long")
