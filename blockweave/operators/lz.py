"""The LZ77 family: greedy and cost-based parsing, and three ways to write the sequences."""

from __future__ import annotations

import struct
from bisect import bisect_left
from itertools import pairwise

import numpy as np

from blockweave.errors import CorruptError
from blockweave.operators import entropy as E
from blockweave.operators.models import read_varint, varint

MIN_MATCH, WINDOW = 3, 4 << 20
#: Earlier places tried by level, and whether a longer match one byte on is preferred.
LEVELS = {1: (1, False), 2: (4, False), 3: (8, True), 4: (16, True), 5: (32, True), 6: (64, True), 7: (128, True)}
DEFAULT_LEVEL, OPTIMAL_DEPTH, SKIP = 2, 16, 32
#: A match of this length is not bettered.
ENOUGH = 1 << 10
# Repeat offsets at the start of a stream.
REPEATS = (1, 4, 8)
Sequence = tuple[int, int, int]


def common(data: bytes, a: int, b: int) -> int:
    """Length of the common run of the bytes at a and b (a < b)."""
    n, step, end = 0, 16, len(data)
    while b + n < end:
        k = min(step, end - b - n)
        x, y = data[a + n : a + n + k], data[b + n : b + n + k]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((differ & -differ).bit_length() - 1 >> 3)
        n, step = n + k, min(step * 2, 1 << 12)
    return n


def previous(data: bytes, k: int) -> np.ndarray:
    """For each place the latest one before it with the same k bytes (3 or 4), or -1."""
    x, m = np.frombuffer(data, np.uint8).astype(np.uint32), len(data) - k + 1
    out = np.full(len(data), -1, np.int32)
    if m > 1:
        key = x[:m].copy()
        for j in range(1, k):
            key |= x[j : j + m] << np.uint32(8 * j)
        order = np.argsort(key.astype(np.uint16), kind="stable")
        order = order[np.argsort((key >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = order[:-1][same]
    return out


class _Chains:
    """Earlier places of each few bytes, latest first."""

    def __init__(self, data: bytes, depth: int, least: int = MIN_MATCH):
        before = previous(data, least)
        self.data, self.depth, self.least, self.prev = data, depth, least, before.tolist()
        #: Places that have an earlier one.
        self.met = np.flatnonzero(before >= 0).tolist()

    def best(self, at: int) -> list[tuple[int, int]]:
        """(length, offset), each longer than those before it."""
        out, longest, place, data, size = [], self.least - 1, self.prev[at], self.data, len(self.data)
        for _ in range(self.depth):
            if place < 0 or at - place > WINDOW or at + longest >= size:
                break
            if data[place + longest] == data[at + longest]:
                n = common(data, place, at)
                if n > longest:
                    longest = n
                    out.append((n, at - place))
                    if n >= ENOUGH:
                        break
            place = self.prev[place]
        return out


def parse_greedy(data: bytes, level: int = 0, least: int = 4) -> list[Sequence]:
    """(literals before, match length, offset): the longest match at each place, or one byte on if lazy. Places
    without an earlier equal few bytes are passed over at once."""
    depth, lazy = LEVELS[min(7, level or DEFAULT_LEVEL)]
    chains, out, at, done, i = _Chains(data, depth, max(MIN_MATCH, min(4, least))), [], 0, 0, 0
    met = chains.met
    while (i := bisect_left(met, at, i)) < len(met):
        at = met[i]
        found = chains.best(at)
        if not found or found[-1][0] < least:
            at += 1
            continue
        n, offset = found[-1]
        if lazy and n < SKIP and at + 1 < len(data):
            later = chains.best(at + 1)
            if later and later[-1][0] > n + 1:
                at += 1
                continue
        out.append((at - done, n, offset))
        at = done = at + n
    return out


def parse_optimal(data: bytes) -> list[Sequence]:
    """The cheapest parse by dynamic programming over estimated bits: a byte costs 8, a match its tag, its
    offset and the length beyond it."""
    n = len(data)
    chains, cost, step = _Chains(data, OPTIMAL_DEPTH), [0.0] + [float("inf")] * n, [(0, 0)] * (n + 1)
    skip, before_any = 0, chains.prev
    for at in range(n):
        here = cost[at]
        if here + 8 < cost[at + 1]:
            cost[at + 1], step[at + 1] = here + 8, (1, 0)
        if at >= skip and before_any[at] >= 0:
            before = MIN_MATCH - 1
            for length, offset in chains.best(at):
                price = here + 24 + 8 * (offset > 65535)
                for m in range(before + 1, min(length, 18) + 1):
                    total = price + 8 * (m > 17)
                    if total < cost[at + m]:
                        cost[at + m], step[at + m] = total, (m, offset)
                if length > 18 and price + 8 < cost[at + length]:
                    cost[at + length], step[at + length] = price + 8, (length, offset)
                before = length
            if before >= 8 * SKIP:
                skip = at + before
    moves, at = [], n
    while at:
        moves.append(step[at])
        at -= step[at][0]
    out, literals = [], 0
    for m, offset in reversed(moves):
        if offset:
            out.append((literals, m, offset))
            literals = 0
        else:
            literals += m
    return out


def fused(seqs: list[Sequence], least: int) -> list[Sequence]:
    """Matches shorter than `least` as literals."""
    out, carry = [], 0
    for literals, m, offset in seqs:
        if m < least:
            carry += literals + m
        else:
            out.append((carry + literals, m, offset))
            carry = 0
    return out


def literals_of(data: bytes, seqs: list[Sequence]) -> tuple[bytes, int]:
    """All literal bytes, and how many follow the last match."""
    parts, at = [], 0
    for literals, m, _ in seqs:
        parts.append(data[at : at + literals])
        at += literals + m
    parts.append(data[at:])
    return b"".join(parts), len(parts[-1])


def descriptors(seqs: list[Sequence]) -> bytes:
    """Tag of both lengths, their extensions, and the offset."""
    out = bytearray()
    for literals, m, offset in seqs:
        m -= MIN_MATCH
        out.append(min(literals, 15) << 4 | min(m, 15))
        if literals >= 15:
            out += b"\xff" * ((literals - 15) // 255) + bytes([(literals - 15) % 255])
        if m >= 15:
            out += varint(m - 15)
        out += struct.pack("<H", offset - 1) if offset <= 65535 else b"\xff\xff" + varint(offset - 65536)
    return bytes(out)


def read_descriptors(data: bytes, count: int, at: int = 0) -> tuple[list[Sequence], int]:
    out = []
    for _ in range(count):
        if at >= len(data):
            raise CorruptError("sequences")
        literals, m = data[at] >> 4, data[at] & 15
        at += 1
        if literals == 15:
            while True:
                if at >= len(data):
                    raise CorruptError("sequences")
                literals, at = literals + data[at], at + 1
                if data[at - 1] < 255:
                    break
        if m == 15:
            more, at = read_varint(data, at)
            m += more
        if at + 2 > len(data):
            raise CorruptError("sequences")
        offset, at = struct.unpack_from("<H", data, at)[0] + 1, at + 2
        if offset == 65536:
            more, at = read_varint(data, at)
            offset += more
        out.append((literals, m + MIN_MATCH, offset))
    return out, at


def rebuild(seqs: list[Sequence], literals: bytes, size: int) -> bytes:
    """The bytes that sequences and literals stand for; exactly `size` or an error."""
    out, at = bytearray(), 0
    for n, m, offset in seqs:
        out += literals[at : at + n]
        at += n
        if at > len(literals) or offset > len(out) or offset < 1 or len(out) + m > size:
            raise CorruptError("match")
        begin = len(out) - offset
        out += out[begin : begin + m] if m <= offset else (bytes(out[begin:]) * (m // offset + 1))[:m]
    out += literals[at:]
    if len(out) != size:
        raise CorruptError("size")
    return bytes(out)


class Lz:
    """Sequences, then all literals; without gain, literals only."""

    def parse(self, data: bytes, params: dict) -> list[Sequence]:
        return parse_greedy(data, params.get("level", 0))

    def encode(self, data, params):
        seqs = self.parse(data, params)
        literals, _ = literals_of(data, seqs)
        out = struct.pack("<II", len(seqs), len(literals)) + descriptors(seqs) + literals
        return out if len(out) < len(data) + 8 else struct.pack("<II", 0, len(data)) + data

    def decode(self, data, size):
        if len(data) < 8:
            raise CorruptError("header")
        count, n = struct.unpack_from("<II", data)
        seqs, at = read_descriptors(data[: len(data) - n] if n <= len(data) - 8 else b"", count, 8)
        if at + n != len(data):
            raise CorruptError("literals")
        return rebuild(seqs, data[at:], size)


class LzOpt(Lz):
    """The same format from the cost-based parser."""

    def parse(self, data, params):
        return parse_optimal(data)


class LzSplit:
    """Cost-based parse; descriptors and literals have a Huffman code each."""

    def encode(self, data, params):
        seqs = parse_optimal(data) if len(data) > MIN_MATCH else []
        literals, tail = literals_of(data, seqs)
        if not seqs:
            return struct.pack("<7I", 0, len(data), len(data), len(data), 0, 0, len(data)) + data
        desc = descriptors(seqs)
        parts = [E.Huffman().encode(x, {}) for x in (desc, literals)]
        return struct.pack("<7I", len(seqs), len(data), len(literals), tail, len(desc), *map(len, parts)) + b"".join(parts)

    def decode(self, data, size):
        if len(data) < 28:
            raise CorruptError("header")
        count, n, n_lit, tail, n_desc, desc, lit = struct.unpack_from("<7I", data)
        if n != size or len(data) != 28 + desc + lit or tail > n_lit:
            raise CorruptError("size")
        if not count:
            return E.Passthrough().decode(data[28:], size)
        seqs, at = read_descriptors(E.Huffman().decode(data[28 : 28 + desc], n_desc), count)
        if at != n_desc:
            raise CorruptError("descriptors")
        return rebuild(seqs, E.Huffman().decode(data[28 + desc :], n_lit), size)


def symbol_of(v: int) -> tuple[int, int, int]:
    """(symbol, extra, extra bits) of a length: 0 and 1 themselves, else one more than the place of the top bit."""
    return (v, 0, 0) if v < 2 else (v.bit_length(), v - (1 << v.bit_length() - 1), v.bit_length() - 1)


def offset_symbol(offset: int, recent: list[int], delta: bool = False) -> tuple[int, int, int]:
    """As symbol_of for an offset: 0 to 2 are the recent ones, which move to the front; others count from 3, by
    themselves or by their zigzag distance to the latest."""
    if offset in recent:
        i = recent.index(offset)
        recent.insert(0, recent.pop(i))
        return i, 0, 0
    gap = offset - recent[0]
    recent.insert(0, offset)
    recent.pop()
    if delta:
        s, extra, bits = symbol_of(gap * 2 if gap >= 0 else -gap * 2 - 1)
        return s + 3, extra, bits
    n = offset.bit_length() - 1
    return n + 3, offset - (1 << n), n


def low_bits(extras: list[tuple[int, int]]) -> bytes:
    """(value, bits) pairs, lowest bit first."""
    out, packed, shift = bytearray(), 0, 0
    for extra, bits in extras:
        packed |= extra << shift
        shift += bits
        while shift >= 8:
            out.append(packed & 255)
            packed, shift = packed >> 8, shift - 8
    return bytes(out) + (bytes([packed]) if shift else b"")


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.window, self.have, self.place = data, 0, 0, 0

    def read(self, k: int) -> int:
        while self.have < k:
            if self.place >= len(self.data):
                raise CorruptError("extra bits")
            self.window |= self.data[self.place] << self.have
            self.have, self.place = self.have + 8, self.place + 1
        v = self.window & (1 << k) - 1
        self.window, self.have = self.window >> k, self.have - k
        return v


class LzStreams:
    """Literals, both lengths and offsets in streams of their own, each under the smallest of three coders;
    extra bits lowest first. Where it is smaller, literals are split by the high half of the one before, new
    offsets are differences, and offsets that are all multiples of a power of two lose it. A negative level
    takes the cost-based parser; delta and contexts, where given, decide those choices."""

    HEADER = struct.Struct("<BBBBIIII4B5I")
    # Flags of the format.
    REPEATED, SHIFTED, CONTEXTS, DELTAS = 0x01, 0x02, 0x04, 0x10
    CONTEXT = struct.Struct("<16B16I16I")
    _CODERS = {E.NONE: E.Passthrough(), E.HUFFMAN: E.Huffman(), E.FSE: E.Rans()}

    def _best(self, data: bytes) -> tuple[int, bytes]:
        """The smallest coder's id and its bytes."""
        k = (E.NONE, E.HUFFMAN, E.FSE)[int(np.argmin(E.sizes(data)))]
        return k, self._CODERS[k].encode(data, {})

    @staticmethod
    def _contexts(literals: bytes) -> list[bytes]:
        x = np.frombuffer(literals, np.uint8)
        before = np.concatenate((np.zeros(1, np.uint8), x[:-1] >> 4))[: len(x)]
        return [x[before == c].tobytes() for c in range(16)]

    def _split(self, parts: list[bytes]) -> bytes:
        done = [self._best(p) for p in parts]
        return self.CONTEXT.pack(*(k for k, _ in done), *map(len, parts), *(len(d) for _, d in done)) + b"".join(d for _, d in done)

    def _join(self, section: bytes, size: int) -> bytes:
        if len(section) < self.CONTEXT.size:
            raise CorruptError("contexts")
        f = self.CONTEXT.unpack_from(section)
        ids, counts, sizes = f[:16], f[16:32], f[32:]
        if sum(counts) != size or self.CONTEXT.size + sum(sizes) != len(section) or any(k not in self._CODERS for k in ids):
            raise CorruptError("contexts")
        ends = np.cumsum([self.CONTEXT.size, *sizes]).tolist()
        parts = [iter(self._CODERS[k].decode(section[a:b], n) if n else b"") for k, n, (a, b) in zip(ids, counts, pairwise(ends), strict=True)]
        out, context = bytearray(), 0
        for _ in range(size):
            byte = next(parts[context], None)
            if byte is None:
                raise CorruptError("contexts")
            out.append(byte)
            context = byte >> 4
        return bytes(out)

    def encode(self, data, params):
        level = params.get("level", 0)
        seqs = fused(parse_optimal(data), params.get("min_match") or MIN_MATCH) if level < 0 else parse_greedy(data, level, params.get("min_match") or 4)
        literals, tail = literals_of(data, seqs)
        every = 0
        for *_, offset in seqs:
            every |= offset
        shift = min(7, (every & -every).bit_length() - 1) if every else 0
        tried = []
        for delta in (False, True) if params.get("delta") is None else (bool(params["delta"]),):
            recent, columns, extras = list(REPEATS), [[], [], []], []
            for n, m, offset in seqs:
                for column, (s, extra, bits) in zip(columns, (symbol_of(n), symbol_of(m - MIN_MATCH), offset_symbol(offset >> shift, recent, delta)), strict=True):
                    column.append(s)
                    extras.append((extra, bits))
            tried.append((sum(E.about(bytes(c)) for c in columns) + sum(b for _, b in extras) // 8, delta, columns, extras))
        _, delta, columns, extras = min(tried, key=lambda t: t[:2])
        parts = self._contexts(literals)
        less = self.CONTEXT.size + sum(map(E.about, parts)) < E.about(literals)
        contexts = bool(literals) and params.get("contexts", less)
        best = [(E.NONE, self._split(parts)) if contexts else self._best(literals), *(self._best(bytes(c)) for c in columns)]
        body = [x for _, x in best] + [low_bits(extras)]
        flags = self.REPEATED | self.SHIFTED * (shift > 0) | self.CONTEXTS * contexts | self.DELTAS * delta
        out = self.HEADER.pack(2, flags, shift, 0, len(seqs), len(literals), tail, len(data), *(k for k, _ in best), *map(len, body)) + b"".join(body)
        if seqs and len(out) < len(data):
            return out
        return self.HEADER.pack(2, 0, 0, 0, 0, len(data), len(data), len(data), 0, 0, 0, 0, len(data), 0, 0, 0, 0) + data

    def decode(self, data, size):
        if len(data) < self.HEADER.size:
            raise CorruptError("header")
        version, flags, shift, zero, count, n_lit, tail, n, *rest = self.HEADER.unpack_from(data)
        ids, sizes = rest[:4], rest[4:]
        known = self.REPEATED | self.SHIFTED | self.CONTEXTS | self.DELTAS
        if version != 2 or flags & ~known or zero or shift > 7 or n != size or n_lit > size or len(data) != self.HEADER.size + sum(sizes) or any(k not in self._CODERS for k in ids) or tail > n_lit:
            raise CorruptError("header")
        ends = np.cumsum([self.HEADER.size, *sizes]).tolist()
        parts = [data[a:b] for a, b in pairwise(ends)]
        literals = self._join(parts[0], n_lit) if flags & self.CONTEXTS else self._CODERS[ids[0]].decode(parts[0], n_lit)
        columns = [self._CODERS[k].decode(p, count) for k, p in zip(ids[1:], parts[1:4], strict=True)]
        bits, recent, seqs = BitReader(parts[4]), list(REPEATS), []
        for a, b, c in zip(*columns, strict=True):
            if max(a, b) > 25 or c > 27:
                raise CorruptError("symbol")
            x, y = (s if s < 2 else (1 << s - 1) + bits.read(s - 1) for s in (a, b))
            if c < 3:
                if not flags & self.REPEATED:
                    raise CorruptError("offset")
                recent.insert(0, recent.pop(c))
            else:
                if flags & self.DELTAS:
                    z = c - 3 if c < 5 else (1 << c - 4) + bits.read(c - 4)
                    offset = recent[0] + (z >> 1 ^ -(z & 1))
                else:
                    offset = (1 << c - 3) + bits.read(c - 3)
                if offset < 1:
                    raise CorruptError("offset")
                recent.insert(0, offset)
                recent.pop()
            seqs.append((x, y + MIN_MATCH, recent[0] << (shift if flags & self.SHIFTED else 0)))
        return rebuild(seqs, literals, size)


CODERS = {E.NONE: E.Passthrough(), E.LZ: Lz(), E.DEFLATE: E.Deflate(), E.HUFFMAN: E.Huffman(), E.FSE: E.Rans(), E.LANE: E.Lane(), E.LZ_OPT: LzOpt(), E.LZ_STREAMS: LzStreams(), E.LZ_SPLIT: LzSplit(), E.HUFFMAN4: E.Huffman4()}
