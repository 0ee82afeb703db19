"""Transforms of a residual, each with its inverse."""

from __future__ import annotations

import struct

import numpy as np

from blockweave.errors import CorruptError, DTypeError
from blockweave.operators.models import dequantize, quantize
from blockweave.types import DType


class _Base:
    lossy = False

    def out_dtype(self, dtype: DType, params: dict) -> DType:
        return dtype

    def out_size(self, n: int, dtype: DType) -> int:
        """Bytes that n elements become."""
        return n * dtype.size

    def pack(self, params: dict) -> bytes:
        return b""

    def unpack(self, data: bytes) -> dict:
        return {}


class Quantize(_Base):
    """Floats to scaled integers, with loss."""

    lossy = True

    def out_dtype(self, dtype, params):
        if not dtype.is_float:
            raise DTypeError("quantize takes floats")
        return DType(params.get("target", DType.I16))

    def encode(self, x, dtype, params):
        return quantize(x.view(dtype.numpy), float(params["scale"]), float(params.get("offset", 0.0)), self.out_dtype(dtype, params))

    def decode(self, x, dtype, params):
        return dequantize(x.view(self.out_dtype(dtype, params).numpy), params["scale"], params.get("offset", 0.0), dtype)

    def pack(self, params):
        return struct.pack("<ddB", params["scale"], params.get("offset", 0.0), params.get("target", DType.I16))

    def unpack(self, data):
        if len(data) != 17:
            raise CorruptError("quantizer parameters")
        return dict(zip(("scale", "offset", "target"), struct.unpack("<ddB", data), strict=True))


class ZigZag(_Base):
    """Signed to unsigned, small magnitudes first."""

    def out_dtype(self, dtype, params):
        if not (dtype.is_integer and dtype.is_signed):
            raise DTypeError("zigzag takes signed integers")
        return DType[f"U{dtype.size * 8}"]

    def encode(self, x, dtype, params):
        self.out_dtype(dtype, params)
        v = x.view(dtype.numpy)
        return ((v << 1) ^ (v >> (dtype.size * 8 - 1))).view(dtype.bits)

    def decode(self, x, dtype, params):
        u = x.view(dtype.bits)
        return ((u >> 1) ^ (~(u & 1) + 1).astype(dtype.bits)).view(dtype.numpy)


class ByteShuffle(_Base):
    """All first bytes, all second bytes, and so on."""

    def encode(self, x, dtype, params):
        return x.view(np.uint8).reshape(-1, dtype.size).T.ravel().copy()

    def decode(self, x, dtype, params):
        return x.view(np.uint8).reshape(dtype.size, -1).T.ravel().copy().view(dtype.numpy)


class BitShuffle(_Base):
    """Bit planes, lowest byte and bit first, each padded to whole bytes."""

    def out_size(self, n, dtype):
        return dtype.size * 8 * (-(-n // 8))

    def encode(self, x, dtype, params):
        planes = np.unpackbits(x.view(np.uint8).reshape(-1, dtype.size), axis=1, bitorder="little").T
        return np.packbits(planes, axis=1, bitorder="little").ravel()

    def decode(self, x, dtype, params):
        n = params["count"]
        planes = np.unpackbits(x.view(np.uint8).reshape(dtype.size * 8, -1), axis=1, bitorder="little")[:, :n]
        return np.packbits(planes.T, axis=1, bitorder="little").ravel().view(dtype.numpy)


class Complement(_Base):
    """Bitwise not; its own inverse."""

    def encode(self, x, dtype, params):
        return (~x.view(dtype.bits)).view(dtype.numpy)

    decode = encode


# Transform ids of the on-disk format.
TRANSFORMS = {0x0001: Quantize(), 0x0002: ZigZag(), 0x0003: ByteShuffle(), 0x0004: BitShuffle(), 0x0100: Complement()}
QUANTIZE, ZIGZAG, BYTE_SHUFFLE, BIT_SHUFFLE, COMPLEMENT = TRANSFORMS
