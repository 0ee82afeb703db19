"""Byte streams in and out: elements are pushed in any portions, records pulled in any portions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockweave.errors import BlockError, CorruptError, LayoutError
from blockweave.operators.blocks import from_block
from blockweave.sources.record import HEADER, decode_block, encode_block, read_record
from blockweave.spec import CodecSpec
from blockweave.types import Block, DType

TARGET = 1 << 20


class PushEncoder:
    """Cuts pushed element bytes into blocks of `target` elements."""

    def __init__(self, dtype: DType, spec: CodecSpec | None = None, target: int = TARGET):
        if dtype.is_variable:
            raise LayoutError("fixed-width elements only")
        if target < 1:
            raise BlockError("target")
        self.dtype, self.spec, self.target = dtype, spec or CodecSpec(), target
        self.reset()

    def reset(self) -> None:
        self._held, self._out, self.blocks, self.bytes, self.ended = bytearray(), bytearray(), 0, 0, False

    def push(self, data: bytes) -> None:
        if self.ended:
            raise BlockError("finished")
        self._held += data
        size = self.target * self.dtype.size
        while len(self._held) >= size:
            self._emit(size)

    def _emit(self, size: int) -> None:
        block = Block(np.frombuffer(bytes(self._held[:size]), self.dtype.numpy), self.dtype)
        self._out += encode_block(block, self.spec)
        del self._held[:size]
        self.blocks, self.bytes = self.blocks + 1, self.bytes + size

    def pull(self, most: int) -> tuple[bytes, bool]:
        """Up to `most` record bytes, and whether more are ready."""
        out = bytes(self._out[:most])
        del self._out[:most]
        return out, bool(self._out)

    def flush(self) -> None:
        """A short block of the whole elements held."""
        size = len(self._held) // self.dtype.size * self.dtype.size
        if size:
            self._emit(size)

    def finish(self) -> None:
        if len(self._held) % self.dtype.size:
            raise BlockError("part of an element is left")
        self.flush()
        self.ended = True

    def checkpoint(self) -> dict:
        """Blocks and element bytes that were encoded; what is held back is not in it."""
        return {"blocks": self.blocks, "bytes": self.bytes}


class PushDecoder:
    """Takes record bytes in any portions and gives blocks; an error stays."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self._held, self.blocks, self.bytes, self.ended, self._error = bytearray(), 0, 0, False, None

    def push(self, data: bytes) -> int:
        if self.ended:
            raise BlockError("finished")
        self._held += data
        return len(data)

    def finish(self) -> None:
        self.ended = True

    def next(self) -> tuple[Block | None, bool]:
        """A block, or None if more bytes are needed; and whether the stream is done."""
        if self._error:
            raise self._error
        try:
            size = self._ready()
            if size:
                block = decode_block(bytes(self._held[:size]))
                del self._held[:size]
                self.blocks, self.bytes = self.blocks + 1, self.bytes + size
                return block, False
            if self.ended and self._held:
                raise CorruptError("bytes after the last record")
        except BlockError as e:
            self._error = e
            raise
        return None, self.ended

    def _ready(self) -> int:
        if len(self._held) < HEADER.size:
            return 0
        f = HEADER.unpack_from(self._held)
        size = HEADER.size + sum(f[-4:])
        if len(self._held) < size:
            if self._held[:4] != b"BLKB":
                raise CorruptError("not a record")
            return 0
        return read_record(bytes(self._held[:size])).size

    def checkpoint(self) -> dict:
        return {"blocks": self.blocks, "bytes": self.bytes}


def encode_stream(rows: DataFrame, key: str, value: str, dtype: DType, spec: CodecSpec, target: int, order: str | None = None) -> DataFrame:
    """Records (key, seq, n, record) of a streaming or static DataFrame: a block a key whenever `target` elements
    have come, with the rest as state. Within a micro-batch elements are in `order`; across them as they came.
    A key that is quiet for a minute of processing time has its rest flushed."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, seq long, n long, record binary"

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seq = state.get if state.exists else (b"", 0)
        encoder, out = PushEncoder(dtype, spec, target), []
        if state.hasTimedOut:
            encoder.push(bytes(held))
            encoder.flush()
        else:
            parts = list(frames)
            frame = pd.concat(parts) if parts else pd.DataFrame({value: []})
            if order:
                frame = frame.sort_values(order, kind="stable")
            encoder.push(bytes(held) + frame[value].to_numpy().astype(dtype.numpy).tobytes())
        data, at = encoder.pull(1 << 62)[0], 0
        while at < len(data):
            r = read_record(data, at)
            out.append((group[0], seq, r.shape[0], data[at : at + r.size]))
            at, seq = at + r.size, seq + 1
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((bytes(encoder._held), seq))
            state.setTimeoutDuration(60_000)
        yield pd.DataFrame(out, columns=[key, "seq", "n", "record"])

    return rows.groupBy(key).applyInPandasWithState(run, schema, "held binary, seq long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def decode_stream(portions: DataFrame, key: str, data: str, dtype: DType, order: str | None = None, ended: str | None = None) -> DataFrame:
    """Elements (key, block, i, v, error) from record bytes in portions of any size, of a streaming or static
    DataFrame. What is not a whole record yet waits as state. Within a micro-batch portions are in `order`; across
    them as they come. A key whose bytes are not records gives one row with the error, and nothing more after it;
    so does one whose portion with a true `ended` leaves bytes over. Bytes after an end begin a new stream."""
    kind = dtype.spark
    schema = f"{key} {portions.schema[key].dataType.simpleString()}, block long, i long, v {kind.simpleString()}, error string"

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, blocks, corrupt = state.get if state.exists else (b"", 0, False)
        parts = list(frames)
        frame = pd.concat(parts) if parts else pd.DataFrame({data: []})
        if order:
            frame = frame.sort_values(order, kind="stable")
        decoder, out = PushDecoder(), []
        decoder.push(bytes(held))
        for part, last in zip(frame[data], frame[ended] if ended else [False] * len(frame), strict=True):
            if corrupt:
                break
            if part is not None:
                decoder.push(bytes(part))
            if last:
                decoder.finish()
            try:
                while (block := decoder.next()[0]) is not None:
                    if block.dtype is not dtype:
                        raise CorruptError(f"a block of {block.dtype.name}")
                    values = from_block(block).to_pylist()
                    out += [(group[0], blocks, i, v, None) for i, v in enumerate(values)]
                    blocks += 1
            except BlockError as e:
                corrupt = True
                out.append((group[0], blocks, None, None, f"{type(e).__name__}: {e}"))
            if last:
                decoder, blocks = PushDecoder(), 0 if not corrupt else blocks
        state.update((b"" if corrupt else bytes(decoder._held), blocks, corrupt))
        frame = pd.DataFrame(out, columns=[key, "block", "i", "v", "error"], dtype=object)  # long integers beside nulls
        yield frame.astype({"block": "Int64", "i": "Int64", **({} if dtype.is_float or dtype.is_variable else {"v": "Int64"})})

    return portions.groupBy(key).applyInPandasWithState(run, schema, "held binary, blocks long, corrupt boolean", "append", GroupStateTimeout.NoTimeout)
