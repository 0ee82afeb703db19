"""Entropy coders: bytes to bytes, with the decoded size known to the decoder."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

from blockweave.errors import BlockError, CorruptError

# Coder ids of the on-disk format.
NONE, LZ, DEFLATE, HUFFMAN, FSE, LANE, LZ_OPT, LZ_STREAMS, LZ_SPLIT, HUFFMAN4 = range(10)
MAX_BITS = 15
#: Bytes below which four streams are not worth their header.
SMALL = 256
MAX_LANES = 8
RANS_LOW = 1 << 16


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise CorruptError(what)


class Passthrough:
    def encode(self, data: bytes, params: dict) -> bytes:
        return data

    def decode(self, data: bytes, size: int) -> bytes:
        _need(len(data) == size, "size")
        return data


class Deflate:
    def encode(self, data, params):
        return zlib.compress(data, params.get("level") or -1)

    def decode(self, data, size):
        try:
            out = zlib.decompress(data)
        except zlib.error as e:
            raise CorruptError(str(e)) from e
        _need(len(out) == size, "size")
        return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most MAX_BITS; counts are halved until they fit."""
    counts = counts.astype(np.int64).copy()
    while True:
        used = np.flatnonzero(counts)
        lengths = np.zeros(256, np.uint8)
        if len(used) == 1:
            lengths[used] = 1
        heap = [(int(counts[s]), int(s), [int(s)]) for s in used]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            lengths[x] += 1
            lengths[y] += 1
            heapq.heappush(heap, (a + b, 256 + min(i, j), x + y))
        if lengths.max(initial=0) <= MAX_BITS:
            return lengths
        counts = np.where(counts > 1, counts // 2, counts)


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then symbol."""
    codes, code, before = np.zeros(256, np.int64), 0, 0
    for s in np.lexsort((np.arange(256), lengths)):
        if lengths[s]:
            code = (code << int(lengths[s]) - before) if before else 0
            codes[s], before = code, int(lengths[s])
            code += 1
    return codes


def _pack_bits(data: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, int]:
    """The codes of all symbols, highest bit first, and the number of bits. Each code is put where it begins in a
    window of two 32-bit words; codes that begin in one word are summed."""
    if not len(data):
        return b"", 0
    n = lengths[data].astype(np.int64)
    ends = np.cumsum(n)
    at, total = ends - n, int(ends[-1])
    word = at >> 5
    two = codes[data].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(total // 32 + 2, np.uint64)
    out[word[first]] += np.add.reduceat(two >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(two & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: -(-total // 8)], total


#: Bytes of a bit stream that are taken at a time, and symbols between two places that are found one by one.
SEGMENT, STRIDE = 1 << 16, 32


def _read_codes(data: bytes, count: int, lengths: np.ndarray) -> bytes:
    """`count` symbols from a bit stream. Each bit's following MAX_BITS bits look up a symbol and where the next code
    would begin; doubling these steps gives the place STRIDE codes on from everywhere, a short loop walks
    along those, and the places between follow all at once."""
    codes, symbol, size = canonical_codes(lengths), np.zeros(1 << MAX_BITS, np.uint8), np.zeros(1 << MAX_BITS, np.uint8)
    for s in np.flatnonzero(lengths):
        free = MAX_BITS - int(lengths[s])
        begin = int(codes[s]) << free
        _need(begin + (1 << free) <= 1 << MAX_BITS, "code lengths")
        symbol[begin : begin + (1 << free)], size[begin : begin + (1 << free)] = s, lengths[s]
    raw, n = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(2, np.uint8))).astype(np.uint32), 8 * len(data)
    out: list[np.ndarray] = []
    have = at = 0
    while have < count:
        base = at >> 3
        part = raw[base : base + SEGMENT + 2]
        m = 8 * (len(part) - 2)
        bound = m if 8 * base + m == n else m - MAX_BITS
        three, ahead = part[:-2] << 16 | part[1:-1] << 8 | part[2:], np.empty(m, np.uint16)
        for k in range(8):
            ahead[k::8] = three >> (24 - MAX_BITS - k) & ((1 << MAX_BITS) - 1)
        step = np.zeros(m + MAX_BITS, np.uint8)
        step[:bound] = size[ahead[:bound]]
        jumps = [np.arange(m + MAX_BITS, dtype=np.int32) + step]
        while 1 << (len(jumps) - 1) < STRIDE:
            jumps.append(jumps[-1][jumps[-1]])
        place, far, found = at - 8 * base, jumps[-1], []
        for _ in range(-(-(count - have) // STRIDE)):
            found.append(place)
            place = far.item(place) if place < len(far) else place
            if place == found[-1]:
                break
        where = np.empty((len(found), STRIDE), np.int32)
        where[:, 0] = found
        for k in range(len(jumps) - 2, -1, -1):
            where[:, 1 << k :: 2 << k] = jumps[k][where[:, :: 2 << k]]
        where = where.ravel()[: count - have]
        k = int(np.count_nonzero(step[where]))  # a place without a code steps to itself, so those come last
        _need(k > 0, "bit stream")
        out.append(symbol[ahead[where[:k]]])
        have, at = have + k, 8 * base + int(jumps[0][where[k - 1]])
    _need(at <= n, "bit stream")
    return np.concatenate(out).tobytes() if out else b""


def _header(data: bytes) -> tuple[int, int, np.ndarray, int]:
    _need(len(data) >= 10, "header")
    size, bits, n = struct.unpack_from("<IIH", data)
    _need(n <= 256 and len(data) >= 10 + n, "code lengths")
    lengths = np.zeros(256, np.uint8)
    lengths[:n] = np.frombuffer(data, np.uint8, n, 10)
    _need(int(lengths.max(initial=0)) <= MAX_BITS, "code lengths")
    return size, bits, lengths, 10 + n


class Huffman:
    """Canonical codes, highest bit first, after their lengths."""

    def encode(self, data, params):
        x = np.frombuffer(data, np.uint8)
        lengths = code_lengths(np.bincount(x, minlength=256))
        n = int(np.flatnonzero(lengths)[-1]) + 1 if len(x) else 0
        stream, bits = _pack_bits(x, lengths, canonical_codes(lengths))
        return struct.pack("<IIH", len(x), bits, n) + lengths[:n].tobytes() + stream

    def decode(self, data, size):
        n, bits, lengths, at = _header(data)
        _need(n == size and len(data) == at + -(-bits // 8), "size")
        return _read_codes(data[at:], size, lengths)


class Huffman4:
    """One code, four streams of a quarter each; small inputs go to Huffman."""

    def encode(self, data, params):
        if len(data) < SMALL:
            return Huffman().encode(data, params)
        x = np.frombuffer(data, np.uint8)
        lengths = code_lengths(np.bincount(x, minlength=256))
        codes, n, part = canonical_codes(lengths), int(np.flatnonzero(lengths)[-1]) + 1, -(-len(x) // 4)
        streams = [_pack_bits(x[i * part : (i + 1) * part], lengths, codes)[0] for i in range(4)]
        return struct.pack("<IIH", len(x), 0, n) + lengths[:n].tobytes() + struct.pack("<III", *map(len, streams[:3])) + b"".join(streams)

    def decode(self, data, size):
        if size < SMALL:
            return Huffman().decode(data, size)
        n, _, lengths, at = _header(data)
        _need(n == size and len(data) >= at + 12, "size")
        part, ends = -(-size // 4), np.cumsum([at + 12, *struct.unpack_from("<III", data, at)])
        _need(ends[-1] <= len(data), "streams")
        return b"".join(_read_codes(data[a:b], max(0, min(part, size - i * part)), lengths) for i, (a, b) in enumerate(zip(ends, [*ends[1:], len(data)], strict=True)))


def table_log(symbols: int) -> int:
    """Precision by the number of distinct symbols."""
    for most, log in ((2, 5), (8, 6), (32, 7), (64, 8), (128, 9), (200, 10)):
        if symbols <= most:
            return log
    return 11


def normalized(counts: np.ndarray, total: int) -> np.ndarray:
    """Counts scaled to sum to `total`, at least 1 where they were above 0; what is left goes to the most
    frequent symbol, what is too much comes from the largest."""
    n = int(counts.sum())
    out = np.where(counts > 0, np.clip(counts.astype(np.int64) * total // max(n, 1), 1, total), 0)
    spare = total - int(out.sum())
    if spare > 0:
        out[int(np.argmax(counts))] += spare
    for _ in range(-spare):
        out[int(np.argmax(out))] -= 1
    return out


class Rans:
    """Range ANS a byte; the state and the scaled counts come first."""

    def encode(self, data, params):
        x = np.frombuffer(data, np.uint8)
        if not len(x):
            return struct.pack("<IIIBBH", 0, 0, RANS_LOW, 5, 0, 0)
        counts = np.bincount(x, minlength=256)
        top, log = int(np.flatnonzero(counts)[-1]) + 1, table_log(int((counts > 0).sum()))
        norm = normalized(counts[:top], 1 << log)
        freq, low = norm.tolist(), (np.cumsum(norm) - norm).tolist()
        limit = [((RANS_LOW >> log) << 8) * f for f in freq]
        state, out = RANS_LOW, bytearray()
        for s in reversed(data):
            while state >= limit[s]:
                out.append(state & 255)
                state >>= 8
            f = freq[s]
            q = state // f
            state = (q << log) + state - q * f + low[s]
        return struct.pack("<IIIBBH", len(x), len(out), state, log, 0, top) + norm.astype("<u2").tobytes() + bytes(reversed(out))

    def decode(self, data, size):
        _need(len(data) >= 16, "header")
        n, length, state, log, zero, top = struct.unpack_from("<IIIBBH", data)
        at = 16 + 2 * top
        _need(n == size and zero == 0 and 5 <= log <= 12 and top <= 256 and len(data) == at + length, "header")
        if not size:
            return b""
        norm = np.frombuffer(data, "<u2", top, 16).astype(np.int64)
        _need(int(norm.sum()) == 1 << log and state >= RANS_LOW, "counts")
        symbol = np.repeat(np.arange(top), norm)
        freq, spare = norm[symbol].tolist(), (np.arange(1 << log) - (np.cumsum(norm) - norm)[symbol]).tolist()
        mask, slots, low = (1 << log) - 1, [], RANS_LOW
        put, left = slots.append, iter(data[at:])
        try:
            for _ in range(size):
                slot = state & mask
                put(slot)
                state = freq[slot] * (state >> log) + spare[slot]
                while state < low:
                    state = state << 8 | next(left)
        except StopIteration:
            raise CorruptError("byte stream") from None
        _need(next(left, None) is None, "byte stream")
        return symbol.astype(np.uint8)[np.array(slots)].tobytes()


def sizes(data: bytes) -> tuple[int, int, int]:
    """Bytes that NONE, HUFFMAN and (nearly) FSE take."""
    if not data:
        return 0, 10, 16
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = code_lengths(counts)
    top, log = int(np.flatnonzero(counts)[-1]) + 1, table_log(int((counts > 0).sum()))
    norm = normalized(counts[:top], 1 << log)
    bits = float((counts[:top][norm > 0] * (log - np.log2(norm[norm > 0]))).sum())
    return len(data), 10 + top - (-int((counts * lengths).sum()) // 8), 16 + 2 * top + 2 + int(bits / 8)


def shannon(data: bytes) -> float:
    """Bits a byte of the order-0 entropy."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum())


def about(data: bytes) -> int:
    """Bytes that the best coder takes, by the entropy."""
    top = max(data) + 1 if data else 0
    return min(len(data), 10 + top + int(len(data) * shannon(data) / 8)) if data else 0


def lane_choice(entropy: float) -> int:
    return NONE if entropy > 7.5 else HUFFMAN if entropy < 4.0 else FSE


class Lane:
    """Equal parts, each with a coder of its own, by entropy where it isn't given."""

    def encode(self, data, params):
        n, given = params.get("n_lanes", 1), params.get("lanes", ())
        if not 1 <= n <= MAX_LANES or len(data) % n:
            raise BlockError("lanes must divide the data")
        size = len(data) // n
        parts = [data[i * size : (i + 1) * size] for i in range(n)]
        ids = [(given[i] if i < len(given) else NONE) or lane_choice(shannon(p)) for i, p in enumerate(parts)]
        done = [_SUB[k].encode(p, {}) for k, p in zip(ids, parts, strict=True)]
        return bytes([n, *ids]) + struct.pack(f"<{n + 1}I", size, *map(len, done)) + b"".join(done)

    def decode(self, data, size):
        n = data[0] if data else 0
        _need(1 <= n <= MAX_LANES and len(data) >= 1 + n + 4 * (n + 1), "lanes")
        ids, (lane, *sizes) = data[1 : 1 + n], struct.unpack_from(f"<{n + 1}I", data, 1 + n)
        at = 1 + n + 4 * (n + 1)
        _need(lane * n == size and at + sum(sizes) == len(data) and all(k in _SUB for k in ids), "lanes")
        out = []
        for k, s in zip(ids, sizes, strict=True):
            out.append(_SUB[k].decode(data[at : at + s], lane))
            at += s
        return b"".join(out)


_SUB = {NONE: Passthrough(), HUFFMAN: Huffman(), FSE: Rans()}
