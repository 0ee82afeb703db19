"""Predictive models on one block: encode to a residual and side data, decode back.

These run on a block at a time inside Arrow batches; where Spark can plan the arithmetic itself, see
`blockweave.operators.columnar`.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from blockweave.errors import BlockError, CorruptError, DTypeError, LayoutError, UnsupportedError
from blockweave.types import Block, DType, Layout, from_ordered, to_ordered

INTS = frozenset(d for d in DType if d.is_integer)
FLOATS = frozenset(d for d in DType if d.is_float)
FIXED = INTS | FLOATS
NARROW = frozenset(d for d in INTS if d.size <= 4)
WIDE = frozenset(d for d in FIXED if d.size > 1 and d is not DType.F16)

# Predictor ids of the on-disk format.
AUTO, LEFT, UP, AVERAGE, PAETH = range(5)
FRONT3, AVG3, GRAD3D, PAETH3D = 3, 4, 5, 6
#: Elements that AUTO scores.
AUTO_SAMPLE = 10_000
PLANE_TILE, PLANE_SCALE = 32, 256


@dataclass
class Encoded:
    residual: np.ndarray
    dtype: DType
    side: bytes = b""


class Model(Protocol):
    dtypes: frozenset
    layouts: frozenset

    def encode(self, block: Block, params: dict) -> Encoded: ...
    def decode(self, enc: Encoded, dtype: DType, shape: tuple[int, ...]) -> np.ndarray | list[bytes]: ...
    def residual_dtype(self, dtype: DType, side: bytes) -> DType: ...


class _Base:
    dtypes, layouts = FIXED, frozenset(Layout)
    lossy = False

    def residual_dtype(self, dtype: DType, side: bytes) -> DType:
        return dtype

    def check(self, block: Block) -> None:
        if block.dtype not in self.dtypes:
            raise DTypeError(f"{type(self).__name__} does not take {block.dtype.name}")
        if block.layout not in self.layouts:
            raise LayoutError(f"{type(self).__name__} does not take {block.layout.name}")


class Raw(_Base):
    """The elements themselves."""

    def encode(self, block: Block, params: dict) -> Encoded:
        return Encoded(block.data, block.dtype)

    def decode(self, enc, dtype, shape):
        return enc.residual


ONE_D = frozenset({Layout.VECTOR_1D})


class Delta(_Base):
    """Integers: differences modulo 2**N. Floats: XOR of neighbouring bit patterns."""

    layouts = ONE_D

    def encode(self, block, params):
        u = block.data.view(block.dtype.bits)
        before = np.concatenate((np.zeros(1, u.dtype), u[:-1]))[: len(u)]
        r = u ^ before if block.dtype.is_float else u - before
        return Encoded(r.view(block.dtype.numpy), block.dtype)

    def decode(self, enc, dtype, shape):
        r = enc.residual.view(dtype.bits)
        out = np.bitwise_xor.accumulate(r) if dtype.is_float else np.cumsum(r, dtype=r.dtype)
        return out.astype(dtype.bits).view(dtype.numpy)


class Delta2(_Base):
    """XOR of XORs; the first two places hold the first XORs themselves."""

    dtypes, layouts = FLOATS, ONE_D

    def encode(self, block, params):
        u = block.data.view(block.dtype.bits)
        d = u.copy()
        d[1:] ^= u[:-1]
        r = d.copy()
        r[2:] ^= d[1:-1]
        return Encoded(r.view(block.dtype.numpy), block.dtype)

    def decode(self, enc, dtype, shape):
        d = enc.residual.view(dtype.bits).copy()
        d[1:] = np.bitwise_xor.accumulate(d[1:])
        return np.bitwise_xor.accumulate(d).view(dtype.numpy)


class Fpc(_Base):
    """Two hash-table predictors, of the next value and of the next difference; each element is XORed with the
    one that leaves more leading zero bytes (ties: the second), and a bit says which."""

    dtypes, layouts = FLOATS, ONE_D
    LOG = 10
    # Fixed value: the multiplier of the format's hash.
    MULTIPLIER = 0x9E3779B97F4A7C15

    def _slots(self, x: np.ndarray) -> np.ndarray:
        """The slot that each element finds, by the one before it."""
        hashed = (x[:-1].astype(np.uint64) * np.uint64(self.MULTIPLIER)) >> np.uint64(64 - self.LOG)
        return np.concatenate((np.zeros(1, np.uint16), hashed.astype(np.uint16)))[: len(x)]

    @staticmethod
    def _held(slots: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What each element's slot holds: the latest element before it that found the same slot, or 0."""
        order = np.argsort(slots, kind="stable")
        out, same = np.zeros(len(x), x.dtype), slots[order[1:]] == slots[order[:-1]]
        out[order[1:][same]] = x[order[:-1][same]]
        return out

    def encode(self, block, params):
        u = block.data.view(block.dtype.bits).view(f"u{block.dtype.size}")
        before = np.concatenate((np.zeros(1, u.dtype), u[:-1]))[: len(u)]
        gap = u - before
        first, second = u ^ self._held(self._slots(u), u), u ^ (self._held(self._slots(gap), gap) + before)
        used = [sum((x >> u.dtype.type(8 * k) != 0).astype(np.int8) for k in range(block.dtype.size)) for x in (first, second)]
        takes = used[1] <= used[0]
        out = np.where(takes, second, first)
        return Encoded(out.view(block.dtype.bits).view(block.dtype.numpy), block.dtype, bytes([self.LOG]) + np.packbits(takes, bitorder="little").tobytes())

    def decode(self, enc, dtype, shape):
        r = enc.residual.view(dtype.bits).view(f"u{dtype.size}").tolist()
        if len(enc.side) != 1 + -(-len(r) // 8) or enc.side[0] != self.LOG:
            raise CorruptError("FPC side data")
        bits = np.unpackbits(np.frombuffer(enc.side, np.uint8, offset=1), bitorder="little").tolist()
        size, mask, shift, by = 1 << self.LOG, (1 << 8 * dtype.size) - 1, 64 - self.LOG, self.MULTIPLIER
        values, gaps, a, b, last, out, whole = [0] * size, [0] * size, 0, 0, 0, [], 2**64 - 1
        put = out.append
        for x, takes in zip(r, bits, strict=False):
            v = x ^ ((gaps[b] + last) & mask if takes else values[a])
            gap = (v - last) & mask
            values[a], gaps[b], last = v, gap, v
            a, b = (v * by & whole) >> shift, (gap * by & whole) >> shift
            put(v)
        return np.array(out, f"u{dtype.size}").view(dtype.bits).view(dtype.numpy)


def first_seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct keys in the order of their first occurrence, and each key's rank in it."""
    _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    return at[order], rank[inverse.reshape(-1)]


class Dict(_Base):
    """Strings: a dictionary in order of first occurrence, and an index an element."""

    dtypes, layouts = frozenset({DType.STRING}), ONE_D

    def residual_dtype(self, dtype, side):
        return DType.U32

    def encode(self, block, params):
        seen: dict[bytes, int] = {}
        codes = np.array([seen.setdefault(bytes(x), len(seen)) for x in block.data], np.uint32)
        ends = np.cumsum([0, *(len(x) for x in seen)]).astype("<u4")
        return Encoded(codes, DType.U32, struct.pack("<II", len(seen), int(ends[-1])) + ends.tobytes() + b"".join(seen))

    @staticmethod
    def entries(side: bytes) -> list[bytes]:
        if len(side) < 12:
            raise CorruptError("dictionary")
        n, size = struct.unpack_from("<II", side)
        if len(side) != 8 + 4 * (n + 1) + size:
            raise CorruptError("dictionary")
        ends, heap = np.frombuffer(side, "<u4", n + 1, 8), side[8 + 4 * (n + 1) :]
        if ends[0] or ends[-1] != size or (np.diff(ends.astype(np.int64)) < 0).any():
            raise CorruptError("dictionary offsets")
        return [heap[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, enc, dtype, shape):
        words = self.entries(enc.side)
        if len(enc.residual) and int(enc.residual.max()) >= len(words):
            raise CorruptError("dictionary index")
        return [words[i] for i in enc.residual]


class DictNumeric(_Base):
    """As Dict for numbers, told apart by their bytes."""

    dtypes, layouts = WIDE, ONE_D

    def residual_dtype(self, dtype, side):
        return DType.U32

    def encode(self, block, params):
        at, codes = first_seen(block.data.view(block.dtype.bits))
        return Encoded(codes.astype(np.uint32), DType.U32, struct.pack("<BI", block.dtype, len(at)) + block.data[at].tobytes())

    def decode(self, enc, dtype, shape):
        kind, n = struct.unpack_from("<BI", enc.side) if len(enc.side) >= 5 else (0, 0)
        if kind != dtype or len(enc.side) != 5 + n * dtype.size:
            raise CorruptError("dictionary")
        values = np.frombuffer(enc.side, dtype.numpy, n, 5)
        if len(enc.residual) and int(enc.residual.max()) >= n:
            raise CorruptError("dictionary index")
        return values[enc.residual] if n else values


class SparseZero(_Base):
    """Places and values of the elements that have a bit set."""

    dtypes, layouts = WIDE, ONE_D

    def residual_dtype(self, dtype, side):
        return DType.U32

    def encode(self, block, params):
        at = np.flatnonzero(block.data.view(block.dtype.bits))
        return Encoded(at.astype(np.uint32), DType.U32, struct.pack("<BI", block.dtype, len(at)) + block.data[at].tobytes())

    def decode(self, enc, dtype, shape):
        kind, n = struct.unpack_from("<BI", enc.side) if len(enc.side) >= 5 else (0, 0)
        at = enc.residual.astype(np.int64)
        if kind != dtype or len(enc.side) != 5 + n * dtype.size or len(at) != n or (np.diff(at) <= 0).any() or (n and at[-1] >= shape[0]):
            raise CorruptError("sparse entries")
        out = np.zeros(shape[0], dtype.numpy)
        out[at] = np.frombuffer(enc.side, dtype.numpy, n, 5)
        return out


# Neighbour predictors work on int64 (integers up to 32 bits, 16- and 32-bit floats in order), or on wrapping
# 64-bit words.


def _work(data: np.ndarray, dtype: DType) -> np.ndarray:
    u = to_ordered(data) if dtype.is_float else data
    return u.astype(np.int64) if u.itemsize < 8 else u.view(np.int64)


def _back(v: np.ndarray, dtype: DType) -> np.ndarray:
    u = v.astype(dtype.bits)
    return from_ordered(u, dtype.numpy) if dtype.is_float else u.view(dtype.numpy)


def _half(a: np.ndarray, b: np.ndarray, floor: bool) -> np.ndarray:
    """(a + b) / 2 without overflow, rounded towards zero, or down for ordered words."""
    low = (a & b) + ((a ^ b) >> 1)
    return low if floor else low + ((a ^ b) & 1 & (low < 0))


def _nearest(a, b, c, p):
    """The one of a, b, c that is nearest to p; ties to the first."""
    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _shift(v: np.ndarray, *axes: int) -> np.ndarray:
    """The neighbours one step back along the axes; 0 outside."""
    for axis in axes:
        v = np.roll(v, 1, axis)
        v[(slice(None),) * (axis % v.ndim) + (slice(0, 1),)] = 0
    return v


def predict2d(kind: int, left, up, corner, floor: bool):
    if kind == LEFT:
        return left
    if kind == UP:
        return up
    return _half(left, up, floor) if kind == AVERAGE else _nearest(left, up, corner, left + up - corner)


def _cost(r: np.ndarray, dtype: DType) -> float:
    signed = r.astype(dtype.bits).view(f"<i{dtype.size}").astype(np.float64)
    return float(np.abs(signed).sum())


def choose2d(v: np.ndarray, dtype: DType) -> int:
    """The predictor with the smallest sum of residuals over the first rows, AUTO_SAMPLE elements about."""
    rows = v[: max(1, AUTO_SAMPLE // max(1, v.shape[1]))].copy()
    costs = [_cost(rows - predict2d(k, _shift(rows, 1), _shift(rows, 0), _shift(rows, 0, 1), dtype.is_float), dtype) for k in (LEFT, UP, AVERAGE, PAETH)]
    return 1 + int(np.argmin(costs)) if rows.size else LEFT


def _narrowed(v: np.ndarray, dtype: DType) -> np.ndarray:
    """Working values modulo the width, in the working form."""
    if dtype.size == 8:
        return v
    u = v.astype(dtype.bits)
    return (u if dtype.is_float or not dtype.is_signed else u.view(dtype.numpy)).astype(np.int64)


def encode2d(v: np.ndarray, kind: int, dtype: DType) -> np.ndarray:
    return (v - predict2d(kind, _shift(v, 1), _shift(v, 0), _shift(v, 0, 1), dtype.is_float)).astype(dtype.bits)


def decode2d(r: np.ndarray, kind: int, dtype: DType) -> np.ndarray:
    """LEFT and UP are running sums; the others go along anti-diagonals, whose elements are independent."""
    r = r.astype(np.int64) if r.itemsize < 8 else r.view(np.int64)
    ny, nx = r.shape
    if kind in (LEFT, UP):
        return _narrowed(np.cumsum(r, axis=1 if kind == LEFT else 0), dtype)
    v = np.zeros((ny + 1, nx + 1), np.int64)
    for d in range(ny + nx - 1):
        y = np.arange(max(0, d - nx + 1), min(ny, d + 1))
        x = d - y
        p = predict2d(kind, v[y + 1, x], v[y, x + 1], v[y, x], dtype.is_float)
        v[y + 1, x + 1] = _narrowed(r[y, x] + p, dtype)
    return v[1:, 1:]


class Pred2D(_Base):
    """Left, upper, mean or Paeth neighbour; the kind is chosen by cost where it is AUTO."""

    layouts = frozenset({Layout.RASTER_2D})

    def encode(self, block, params):
        v = _work(block.data, block.dtype).reshape(block.shape)
        kind = params.get("kind", AUTO) or choose2d(v, block.dtype)
        return Encoded(encode2d(v, kind, block.dtype).ravel().view(block.dtype.numpy), block.dtype, bytes([kind]))

    def decode(self, enc, dtype, shape):
        if len(enc.side) != 1 or not LEFT <= enc.side[0] <= PAETH:
            raise CorruptError("predictor kind")
        r = enc.residual.view(dtype.bits).reshape(shape)
        return _back(decode2d(r, enc.side[0], dtype).ravel(), dtype)


class Stack2D(_Base):
    """Pred2D a slice, after an optional difference to the slice before; AUTO looks at the first slice."""

    dtypes, layouts = NARROW | FLOATS, frozenset({Layout.STACK_2D})

    def encode(self, block, params):
        inter = int(bool(params.get("inter_slice", False)))
        u = block.data.view(block.dtype.bits).reshape(block.shape)
        if inter:
            u = u - np.concatenate((np.zeros_like(u[:1]), u[:-1]))
        v = _work(np.ascontiguousarray(u).view(block.dtype.numpy), block.dtype)
        kind = params.get("kind", AUTO) or (choose2d(v[0], block.dtype) if len(v) else LEFT)
        r = np.stack([encode2d(x, kind, block.dtype) for x in v]) if len(v) else u
        return Encoded(r.ravel().view(block.dtype.numpy), block.dtype, bytes([kind, inter]))

    def decode(self, enc, dtype, shape):
        if len(enc.side) != 2 or not LEFT <= enc.side[0] <= PAETH or enc.side[1] > 1:
            raise CorruptError("stack side data")
        r = enc.residual.view(dtype.bits).reshape(shape)
        v = np.stack([_back(decode2d(x, enc.side[0], dtype).ravel(), dtype) for x in r]) if len(r) else r.view(dtype.numpy)
        u = v.view(dtype.bits)
        return (np.cumsum(u, axis=0, dtype=u.dtype) if enc.side[1] else u).ravel().view(dtype.numpy)


def predict3d(kind: int, n: dict[str, np.ndarray], has: dict[str, np.ndarray], floor: bool):
    """n: neighbours a (x-1), b (y-1), c (z-1), ab, ac, bc, abc; has: which of a, b, c are inside."""
    a, b, c = n["a"], n["b"], n["c"]
    if kind in (LEFT, UP, FRONT3):
        return (a, b, c)[kind - 1]
    grad = a + b + c - n["ab"] - n["ac"] - n["bc"] + n["abc"]
    if kind == GRAD3D:
        return grad
    count = has["a"].astype(int) + has["b"] + has["c"]
    if kind == AVG3:
        one = a + b + c
        two = np.where(~has["c"], _half(a, b, floor), np.where(~has["b"], _half(a, c, floor), _half(b, c, floor)))
        if floor:
            three = (one.view(np.uint64) // np.uint64(3)).view(np.int64)
        else:
            three = np.sign(one) * (np.abs(one) // 3)
        return np.where(count == 3, three, np.where(count == 2, two, one))
    full = _nearest(a, b, c, grad)
    faces = np.where(~has["c"], _nearest(a, b, n["ab"], a + b - n["ab"]), np.where(~has["b"], _nearest(a, c, n["ac"], a + c - n["ac"]), _nearest(b, c, n["bc"], b + c - n["bc"])))
    return np.where(count == 3, full, np.where(count == 2, faces, a + b + c))


def _neighbours(v: np.ndarray) -> tuple[dict, dict]:
    axes = {"a": (2,), "b": (1,), "c": (0,), "ab": (1, 2), "ac": (0, 2), "bc": (0, 1), "abc": (0, 1, 2)}
    z, y, x = np.indices(v.shape)
    return {k: _shift(v, *ax) for k, ax in axes.items()}, {"a": x > 0, "b": y > 0, "c": z > 0}


class Pred3D(_Base):
    """The seven causal neighbours of a volume."""

    dtypes, layouts = NARROW | FLOATS, frozenset({Layout.VOLUME_3D})

    def encode(self, block, params):
        v, floor = _work(block.data, block.dtype).reshape(block.shape), block.dtype.is_float
        kind = params.get("kind", AUTO)
        if not kind:
            part = v[: max(1, AUTO_SAMPLE // max(1, v[0].size))].copy() if v.size else v
            near = _neighbours(part)
            kind = 1 + int(np.argmin([_cost(part - predict3d(k, *near, floor), block.dtype) for k in range(LEFT, PAETH3D + 1)])) if v.size else LEFT
        r = (v - predict3d(kind, *_neighbours(v), floor)).astype(block.dtype.bits)
        return Encoded(r.ravel().view(block.dtype.numpy), block.dtype, bytes([kind]))

    def decode(self, enc, dtype, shape):
        if len(enc.side) != 1 or not LEFT <= enc.side[0] <= PAETH3D:
            raise CorruptError("predictor kind")
        kind, r = enc.side[0], enc.residual.view(dtype.bits).reshape(shape)
        r = r.astype(np.int64) if r.itemsize < 8 else r.view(np.int64)
        axes = {LEFT: (2,), UP: (1,), FRONT3: (0,), GRAD3D: (2, 1, 0)}.get(kind)
        if axes:
            for axis in axes:
                r = np.cumsum(r, axis=axis)
            return _back(_narrowed(r, dtype).ravel(), dtype)
        v = np.zeros([n + 1 for n in shape], np.int64)
        place = np.indices(shape).reshape(3, -1)
        order = np.argsort(place.sum(axis=0), kind="stable")
        for at in np.split(order, np.cumsum(np.bincount(place.sum(axis=0)))[:-1]) if r.size else []:
            z, y, x = place[:, at]
            back = {"a": (1, 1, 0), "b": (1, 0, 1), "c": (0, 1, 1), "ab": (1, 0, 0), "ac": (0, 1, 0), "bc": (0, 0, 1), "abc": (0, 0, 0)}
            near = {k: v[z + i, y + j, x + m] for k, (i, j, m) in back.items()}
            p = predict3d(kind, near, {"a": x > 0, "b": y > 0, "c": z > 0}, dtype.is_float)
            v[z + 1, y + 1, x + 1] = _narrowed(r[z, y, x] + p, dtype)
        return _back(v[1:, 1:, 1:].ravel(), dtype)


def fit_plane(v: np.ndarray) -> tuple[int, int, int]:
    """Least squares a + b x + c y of a tile in units of 1 / PLANE_SCALE. On a full grid both places, taken from
    their middles, are uncorrelated: each slope is a quotient of its own, 0 along an extent of one cell, and
    the plane goes through the mean in the middle."""
    v, slopes, corner = v.astype(np.float64), [], v.mean()
    for axis in (1, 0):
        n = v.shape[axis]
        from_middle = np.arange(n) - (n - 1) / 2
        spread = (from_middle @ from_middle) * v.size / n
        slopes.append(from_middle @ v.sum(axis=1 - axis) / spread if n > 1 else 0.0)
        corner -= slopes[-1] * (n - 1) / 2
    return tuple(int(np.sign(c) * np.floor(np.abs(c) * PLANE_SCALE + 0.5)) for c in (corner, *slopes))


def plane_values(abc: tuple[int, int, int], shape: tuple[int, int]) -> np.ndarray:
    y, x = np.indices(shape)
    s = abc[0] + abc[1] * x + abc[2] * y
    return np.sign(s) * ((np.abs(s) + PLANE_SCALE // 2) // PLANE_SCALE)


def varint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes([*out, v])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptError("varint")
        v |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 0x80:
            return v, at


def _i32(v: int) -> int:
    return (v + 2**31) % 2**32 - 2**31


class Plane2D(_Base):
    """A plane a tile; coefficients are stored as differences to those expected from the tile on the left, or
    above in the first column."""

    dtypes, layouts = NARROW, frozenset({Layout.RASTER_2D})

    @staticmethod
    def _tiles(shape, size):
        return [(y, x) for y in range(0, shape[0], size) for x in range(0, shape[1], size)]

    @staticmethod
    def _expected(found: list, i: int, across: int, size: int):
        if i % across:
            a, b, c = found[i - 1]
            return _i32(a + b * size), b, c
        if i:
            a, b, c = found[i - across]
            return _i32(a + c * size), b, c
        return 0, 0, 0

    def encode(self, block, params):
        size = params.get("tile_size") or PLANE_TILE
        v, r = block.data.reshape(block.shape).astype(np.int64), np.zeros(block.shape, np.int64)
        across, found, stream = max(1, -(-block.shape[1] // size)), [], b""
        for i, (y, x) in enumerate(self._tiles(block.shape, size)):
            tile = v[y : y + size, x : x + size]
            found.append(tuple(map(_i32, fit_plane(tile))))
            r[y : y + size, x : x + size] = tile - plane_values(found[-1], tile.shape)
            for got, want in zip(found[-1], self._expected(found, i, across, size), strict=True):
                d = _i32(got - want)
                stream += varint(d * 2 if d >= 0 else -d * 2 - 1)
        out = r.astype(block.dtype.bits)
        return Encoded(out.ravel().view(block.dtype.numpy), block.dtype, struct.pack("<HIBB", size, len(found), int(not out.any()), 0) + stream)

    def decode(self, enc, dtype, shape):
        if len(enc.side) < 8:
            raise CorruptError("plane side data")
        size, n, _, zero = struct.unpack_from("<HIBB", enc.side)
        if not size or zero or n != len(self._tiles(shape, size)):
            raise CorruptError("plane tiles")
        out = enc.residual.view(dtype.bits).reshape(shape).astype(np.int64)
        across, found, at = max(1, -(-shape[1] // size)), [], 8
        for i, (y, x) in enumerate(self._tiles(shape, size)):
            abc = []
            for want in self._expected(found, i, across, size):
                z, at = read_varint(enc.side, at)
                abc.append(_i32(want + (z >> 1 ^ -(z & 1))))
            found.append(tuple(abc))
            tile = out[y : y + size, x : x + size]
            tile += plane_values(found[-1], tile.shape)
        if at != len(enc.side):
            raise CorruptError("plane side data")
        return out.ravel().astype(dtype.bits).view(dtype.numpy)


def quantize(v: np.ndarray, scale: float, offset: float, target: DType) -> np.ndarray:
    """Rounded half away from zero and clamped to the target; NaN is the target's lowest value."""
    if target not in (DType.I8, DType.I16, DType.I32):
        raise DTypeError("quantize to I8, I16 or I32")
    if not scale or not np.isfinite(scale):
        raise BlockError("scale")
    info = np.iinfo(target.numpy)
    x = (v.astype(np.float64) - offset) * scale
    whole = np.trunc(x)
    x = whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)
    return np.where(np.isnan(x), info.min, np.clip(x, info.min, info.max)).astype(target.numpy)


def dequantize(q: np.ndarray, scale: float, offset: float, dtype: DType) -> np.ndarray:
    return (q.astype(np.float64) * (1.0 / scale) + offset).astype(dtype.numpy)


class QuantizePred2D(_Base):
    """Quantize, then Pred2D on the integers."""

    dtypes, layouts, lossy = frozenset({DType.F32, DType.F64}), frozenset({Layout.RASTER_2D}), True

    def residual_dtype(self, dtype, side):
        return DType(side[0])

    def encode(self, block, params):
        target, scale, offset = DType(params.get("target", DType.I16)), float(params["scale"]), float(params.get("offset", 0.0))
        enc = Pred2D().encode(Block(quantize(block.data, scale, offset, target), target, block.layout, block.shape), params)
        return Encoded(enc.residual, target, struct.pack("<BBdd", target, enc.side[0], scale, offset))

    def decode(self, enc, dtype, shape):
        if len(enc.side) != 18:
            raise CorruptError("quantizer")
        target, kind, scale, offset = struct.unpack("<BBdd", enc.side)
        return dequantize(Pred2D().decode(Encoded(enc.residual, DType(target), bytes([kind])), DType(target), shape), scale, offset, dtype)


# Model ids of the on-disk format.
MODELS: dict[int, Model] = {
    0x0001: Raw(),
    0x0002: Delta(),
    0x0003: Dict(),
    0x0004: Pred2D(),
    0x0005: Stack2D(),
    0x0006: Pred3D(),
    0x0007: Plane2D(),
    0x0008: Delta2(),
    0x0009: Fpc(),
    0x000A: DictNumeric(),
    0x000B: SparseZero(),
    0x000C: QuantizePred2D(),
}
RAW, DELTA_1D, DICT_1D, PRED_2D, STACK_2D, PRED_3D, PLANE_2D, DELTA2_1D, FPC_1D, DICT_NUMERIC_1D, SPARSE_ZERO_1D, QUANTIZE_PRED_2D = MODELS


def unknown(kind: str, key: int) -> UnsupportedError:
    return UnsupportedError(f"{kind} {key:#x} is not registered")
