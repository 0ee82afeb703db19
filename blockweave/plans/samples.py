"""Small pieces that queries ship to executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockweave.operators.models import DELTA_1D, Encoded, Raw
from blockweave.operators.transforms import ZIGZAG, Complement
from blockweave.spec import CodecSpec
from blockweave.streaming.pushpull import PushDecoder, PushEncoder
from blockweave.types import Block, DType


class XorCoder:
    """A coder that flips bits; an example of a plugin."""

    def __init__(self, mask: int):
        self.table = bytes(i ^ mask for i in range(256))

    def encode(self, data: bytes, params: dict) -> bytes:
        return data.translate(self.table)

    def decode(self, data: bytes, size: int) -> bytes:
        return data.translate(self.table)


class Negated(Raw):
    """A model that keeps every element with all bits flipped; an example of a plugin."""

    def encode(self, block: Block, params: dict) -> Encoded:
        return Encoded(~block.data.view(block.dtype.bits).view(block.dtype.numpy), block.dtype)

    def decode(self, enc: Encoded, dtype: DType, shape: tuple[int, ...]) -> np.ndarray:
        return ~enc.residual


class Rotated(Complement):
    """A transform that moves bytes on by one; an example of a plugin."""

    def encode(self, x: np.ndarray, dtype: DType, params: dict) -> np.ndarray:
        return np.roll(x.view(np.uint8), 1)

    def decode(self, x: np.ndarray, dtype: DType, params: dict) -> np.ndarray:
        return np.roll(x.view(np.uint8), -1)


def through_streams(df: DataFrame, target: int = 100, portion: int = 777) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        data = table.column("v").to_numpy().astype("<i8").tobytes()
        encoder, decoder, values = PushEncoder(DType.I64, CodecSpec(DELTA_1D, (ZIGZAG,)), target), PushDecoder(), []

        def drain() -> None:
            more = True
            while more:
                part, more = encoder.pull(portion)
                decoder.push(part)
                while (found := decoder.next()[0]) is not None:
                    values.extend(found.data.tolist())

        for at in range(0, len(data), portion):
            encoder.push(data[at : at + portion])
            drain()
        encoder.finish()
        drain()
        decoder.finish()
        decoder.next()
        return pa.table({"blk": table.column("blk"), "i": table.column("i"), "v": pa.array(values, pa.int64())})

    return df.groupBy("blk").applyInArrow(run, "blk long, i long, v long")


def checkpoints(df: DataFrame, target: int, portion: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        values = table.sort_by("i").column("v").to_numpy().astype("<i8")
        encoder, said = PushEncoder(DType.I64, CodecSpec(DELTA_1D, (ZIGZAG,)), target), []
        said.append((0, encoder.checkpoint()))
        for n, at in enumerate(range(0, len(values), portion), 1):
            encoder.push(values[at : at + portion].tobytes())
            said.append((n, encoder.checkpoint()))
        encoder.finish()
        said.append((-1, encoder.checkpoint()))
        blk = table.column("blk")[0].as_py()
        return pa.table({"blk": [blk] * len(said), "portion": [n for n, _ in said], "blocks": [c["blocks"] for _, c in said], "bytes": [c["bytes"] for _, c in said]})

    return df.groupBy("blk").applyInArrow(run, "blk long, portion long, blocks long, bytes long")
