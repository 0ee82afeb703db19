"""Element types, layouts and typed blocks."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

import numpy as np
from pyspark.sql import types as T

from blockweave.errors import DTypeError, LayoutError, ShapeError


class DType(IntEnum):
    # Ids of the on-disk format.
    I8 = 1
    I16 = 2
    I32 = 3
    I64 = 4
    U8 = 5
    U16 = 6
    U32 = 7
    U64 = 8
    F32 = 9
    F64 = 10
    STRING = 11
    F16 = 12

    @property
    def size(self) -> int:
        return 0 if self is DType.STRING else self.numpy.itemsize

    @property
    def numpy(self) -> np.dtype:
        if self is DType.STRING:
            raise DTypeError("strings have no fixed width")
        kind = {"I": "i", "U": "u", "F": "f"}[self.name[0]]
        return np.dtype(f"<{kind}{int(self.name[1:]) // 8}")

    @property
    def bits(self) -> np.dtype:
        """The unsigned integer of the same width."""
        return np.dtype(f"<u{self.size}")

    @property
    def is_float(self) -> bool:
        return self.name[0] == "F"

    @property
    def is_signed(self) -> bool:
        return self.name[0] in "IF"

    @property
    def is_integer(self) -> bool:
        return self.name[0] in "IU"

    @property
    def is_variable(self) -> bool:
        return self is DType.STRING

    @property
    def spark(self) -> T.DataType:
        """The Spark type that holds all values; U64 as the bits of a long."""
        if self is DType.STRING:
            return T.BinaryType()
        if self.is_float:
            return T.DoubleType() if self is DType.F64 else T.FloatType()
        bits = self.size * 8 + (not self.is_signed)
        return T.ByteType() if bits <= 8 else T.ShortType() if bits <= 16 else T.IntegerType() if bits <= 32 else T.LongType()


class Layout(IntEnum):
    # Ids of the on-disk format.
    VECTOR_1D = 1
    RASTER_2D = 2
    STACK_2D = 3
    VOLUME_3D = 4

    @property
    def rank(self) -> int:
        return {1: 1, 2: 2, 3: 3, 4: 3}[self.value]


_FROM_SPARK = {T.ByteType: DType.I8, T.ShortType: DType.I16, T.IntegerType: DType.I32, T.LongType: DType.I64, T.FloatType: DType.F32, T.DoubleType: DType.F64, T.StringType: DType.STRING, T.BinaryType: DType.STRING}


def dtype_of(field: T.StructField) -> DType:
    """The element type of a Spark column; `unsigned_bits` in its metadata makes it unsigned. Timestamps go as
    microseconds in I64. Booleans, decimals, dates, intervals and nested types are rejected."""
    if bits := (field.metadata or {}).get("unsigned_bits"):
        return DType[f"U{bits}"]
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return DType.I64
    found = _FROM_SPARK.get(type(field.dataType))
    if found is None:
        raise DTypeError(f"{field.name}: {field.dataType.simpleString()} has no element type")
    return found


@dataclass
class Block:
    """One typed n-dimensional array, row-major, with optional validity (True: present)."""

    data: np.ndarray | list[bytes]
    dtype: DType
    layout: Layout = Layout.VECTOR_1D
    shape: tuple[int, ...] | None = None
    validity: np.ndarray | None = None

    def __post_init__(self):
        self.shape = tuple(int(n) for n in (self.shape if self.shape is not None else (len(self.data),)))
        if not self.dtype.is_variable:
            self.data = np.ascontiguousarray(self.data, self.dtype.numpy).ravel()

    @property
    def count(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))

    def validate(self) -> Block:
        if len(self.shape) != self.layout.rank or any(n < 0 for n in self.shape):
            raise ShapeError(f"{self.layout.name} needs {self.layout.rank} dimensions that are not negative, not {self.shape}")
        if len(self.data) != self.count:
            raise ShapeError(f"{len(self.data)} elements in a shape of {self.count}")
        if self.dtype.is_variable and self.layout is not Layout.VECTOR_1D:
            raise LayoutError("strings are one-dimensional")
        if self.validity is not None and len(self.validity) != self.count:
            raise ShapeError("validity has another length")
        return self


def to_ordered(x: np.ndarray) -> np.ndarray:
    """Floats as unsigned integers of the same order: all bits of negatives flipped, the sign bit of others."""
    u = x.view(f"<u{x.itemsize}")
    top = u.dtype.type(1 << (8 * x.itemsize - 1))
    return np.where(u & top, ~u, u | top)


def from_ordered(u: np.ndarray, to: np.dtype) -> np.ndarray:
    top = u.dtype.type(1 << (8 * u.itemsize - 1))
    return np.ascontiguousarray(np.where(u & top, u & ~top, ~u)).view(to)
