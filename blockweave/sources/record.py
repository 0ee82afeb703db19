"""Block records: one encoded block, self-describing."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from blockweave.errors import BlockError, CorruptError, LayoutError, ShapeError, TooSmallError, VersionError
from blockweave.operators.models import DICT_1D, Dict, Encoded
from blockweave.registry import find
from blockweave.spec import CodecSpec
from blockweave.types import Block, DType, Layout

# The record's magic number ("BLKB"), version, header and flags.
MAGIC, RECORD_VERSION = 0x424B4C42, 2
HEADER = struct.Struct("<IHHH4H4HBBBBH3qQIIII")
HAS_VALIDITY, LOSSY, ZERO_RESIDUAL = 1, 2, 4


@dataclass(frozen=True)
class Record:
    """A record's header and sections."""

    flags: int
    model: int
    transforms: tuple[int, ...]
    entropies: tuple[int, ...]
    dtype: DType
    layout: Layout
    shape: tuple[int, ...]
    uncompressed: int
    side: bytes
    params: bytes
    payload: bytes
    validity: bytes
    size: int


def _fits(shape: tuple[int, ...]) -> int:
    n = 1
    for d in shape:
        n *= d
    return n


def encode_block(block: Block, spec: CodecSpec | None = None) -> bytes:
    """The record of a block: model, transforms and entropy coders in turn. A model that leaves only zeros ends
    the chain; the payload of an entropy chain starts with the size that each coder was given."""
    spec = spec or CodecSpec()
    block.validate()
    model = find("model", spec.model)
    for kind, ids in (("transform", spec.transforms), ("entropy", spec.entropies)):
        for key in ids:
            find(kind, key)
    model.check(block)
    enc = model.encode(block, dict(spec.model_params))
    flags, params, x, dtype = LOSSY if getattr(model, "lossy", False) else 0, b"", enc.residual, enc.dtype
    zero = spec.model != 1 and len(x) > 0 and not x.view(np.uint8).any() and spec.model != DICT_1D
    if zero:
        flags, data, uncompressed, payload = flags | ZERO_RESIDUAL, b"", x.nbytes, b""
    else:
        for i, key in enumerate(spec.transforms):
            t, p = find("transform", key), spec.params("transform", i)
            out = t.out_dtype(dtype, p)
            x = t.encode(np.ascontiguousarray(x), dtype, p | {"count": len(x.view(np.uint8)) // dtype.size})
            if getattr(t, "lossy", False):
                flags |= LOSSY
            packed = t.pack(p) if hasattr(t, "pack") else b""
            if packed:
                params += struct.pack("<HH", i, len(packed)) + packed
            dtype = out
        data = x.tobytes()
        uncompressed, sizes = len(data), []
        for i, key in enumerate(spec.entropies):
            sizes.append(len(data))
            data = find("entropy", key).encode(data, spec.params("entropy", i))
        payload = struct.pack(f"<{len(sizes)}I", *sizes) + data
    validity = b"" if block.validity is None else np.packbits(np.asarray(block.validity, bool), bitorder="little").tobytes()
    flags |= HAS_VALIDITY if block.validity is not None else 0
    pad = lambda ids: (*ids, *[0] * (4 - len(ids)))
    header = HEADER.pack(MAGIC, RECORD_VERSION, flags, spec.model, *pad(spec.transforms), *pad(spec.entropies), block.dtype, block.layout, len(block.shape), 0, 0, *block.shape, *[0] * (3 - len(block.shape)), uncompressed, len(enc.side), len(payload), len(params), len(validity))
    return header + enc.side + params + payload + validity


def read_record(data: bytes, at: int = 0) -> Record:
    """Header and sections of the record at a place; checks all that can be checked without decoding."""
    if len(data) - at < HEADER.size:
        raise CorruptError("record header")
    f = HEADER.unpack_from(data, at)
    magic, version, flags, model, transforms, entropies = f[0], f[1], f[2], f[3], f[4:8], f[8:12]
    dtype, layout, rank, r0, r1, dims, uncompressed, sizes = f[12], f[13], f[14], f[15], f[16], f[17:20], f[20], f[21:]
    if magic != MAGIC:
        raise CorruptError("not a record")
    if version != RECORD_VERSION:
        raise VersionError(f"record version {version}")
    if r0 or r1 or flags & ~7 or dtype not in iter(DType) or layout not in iter(Layout):
        raise CorruptError("record header")
    if rank != Layout(layout).rank or any(d < 0 for d in dims[:rank]) or any(dims[rank:]) or _fits(dims[:rank]) >= 2**48:
        raise ShapeError("record shape")
    for ids in (transforms, entropies):
        if any(x and not before for before, x in zip(ids, ids[1:], strict=False)):
            raise CorruptError("a stage after the end of the chain")
    side, payload, params, valid = sizes
    if at + HEADER.size + sum(sizes) > len(data):
        raise CorruptError("record sections")
    if bool(flags & HAS_VALIDITY) != bool(valid) and _fits(dims[:rank]) or valid not in (0, -(-_fits(dims[:rank]) // 8)):
        raise CorruptError("validity")
    if flags & ZERO_RESIDUAL and (payload or params):
        raise CorruptError("payload of a zero residual")
    out, place = [], at + HEADER.size
    for n in (side, params, payload, valid):
        out.append(bytes(data[place : place + n]))
        place += n
    strip = lambda ids: tuple(x for x in ids if x)
    return Record(flags, model, strip(transforms), strip(entropies), DType(dtype), Layout(layout), tuple(dims[:rank]), uncompressed, *out, place - at)


def peek(data: bytes, at: int = 0) -> dict:
    """dtype, layout, shape and bytes of the elements (None for strings), from the header alone."""
    r = read_record(data, at)
    return {"dtype": r.dtype, "layout": r.layout, "shape": r.shape, "bytes": None if r.dtype.is_variable else _fits(r.shape) * r.dtype.size}


def _params(r: Record) -> dict[int, bytes]:
    found, at = {}, 0
    while at < len(r.params):
        if at + 4 > len(r.params):
            raise CorruptError("transform parameters")
        slot, n = struct.unpack_from("<HH", r.params, at)
        if slot >= len(r.transforms) or slot in found or at + 4 + n > len(r.params):
            raise CorruptError("transform parameters")
        found[slot], at = r.params[at + 4 : at + 4 + n], at + 4 + n
    return found


def residual(r: Record) -> Encoded:
    """What the model left, after undoing coders and transforms."""
    model = find("model", r.model)
    try:
        dtype = model.residual_dtype(r.dtype, r.side)
    except (IndexError, ValueError) as e:
        raise CorruptError("side data") from e
    if r.flags & ZERO_RESIDUAL:
        if r.uncompressed % dtype.size or r.uncompressed != _fits(r.shape) * dtype.size:
            raise CorruptError("zero residual")
        return Encoded(np.zeros(r.uncompressed // dtype.size, dtype.numpy), dtype, r.side)
    data = r.payload
    if r.entropies:
        n = len(r.entropies)
        if len(data) < 4 * n:
            raise CorruptError("size table")
        sizes, data = struct.unpack_from(f"<{n}I", data), data[4 * n :]
        if sizes[0] != r.uncompressed or sizes[0] > max(64, 16 * (_fits(r.shape) + 16) * 8):
            raise CorruptError("size table")
        for key, size in zip(r.entropies[::-1], sizes[::-1], strict=True):
            data = find("entropy", key).decode(data, size)
    if len(data) != r.uncompressed:
        raise CorruptError("payload size")
    packed, dtypes, params = _params(r), [dtype], []
    for i, key in enumerate(r.transforms):
        t = find("transform", key)
        params.append(t.unpack(packed[i]) if i in packed else {})
        dtypes.append(t.out_dtype(dtypes[-1], params[-1]))
    x = np.frombuffer(data, np.uint8).copy()
    counts = _counts(r, dtypes, len(data))
    for i in range(len(r.transforms) - 1, -1, -1):
        t = find("transform", r.transforms[i])
        if len(x.view(np.uint8)) != t.out_size(counts, dtypes[i]) if r.transforms[i] != 1 else len(x.view(np.uint8)) % dtypes[i + 1].size:
            raise CorruptError("transform size")
        x = t.decode(x, dtypes[i], params[i] | {"count": counts})
    if x.nbytes % dtype.size:
        raise CorruptError("residual size")
    return Encoded(np.ascontiguousarray(x).view(np.uint8).view(dtype.numpy), dtype, r.side)


def _counts(r: Record, dtypes: list[DType], size: int) -> int:
    """Elements of the residual: those of the block, or for sparse entries as many as side data say."""
    from blockweave.operators.models import SPARSE_ZERO_1D

    if r.model == SPARSE_ZERO_1D:
        if len(r.side) < 5:
            raise CorruptError("side data")
        return struct.unpack_from("<I", r.side, 1)[0]
    return _fits(r.shape)


def decode_block(data: bytes | Record, at: int = 0) -> Block:
    """The block of a record, with its validity."""
    r = data if isinstance(data, Record) else read_record(data, at)
    enc = residual(r)
    expected = _counts(r, [], 0)
    if len(enc.residual) != expected:
        raise CorruptError("residual size")
    model = find("model", r.model)
    if r.dtype not in model.dtypes or r.layout not in model.layouts:
        raise CorruptError("model and type")
    try:
        values = model.decode(enc, r.dtype, r.shape)
    except (IndexError, struct.error, OverflowError) as e:
        raise CorruptError(str(e)) from e
    if len(values) != _fits(r.shape):
        raise CorruptError("element count")
    valid = np.unpackbits(np.frombuffer(r.validity, np.uint8), bitorder="little")[: _fits(r.shape)].astype(bool) if r.flags & HAS_VALIDITY else None
    return Block(values, r.dtype, r.layout, r.shape, valid)


def decode_into(data: bytes, out: np.ndarray, at: int = 0) -> int:
    """Decodes a fixed-width block into the caller's array, whose type and size must fit; returns the count."""
    block = decode_block(data, at)
    if block.dtype.is_variable:
        raise LayoutError("strings have no fixed width")
    if out.dtype != block.dtype.numpy:
        raise BlockError(f"the array is {out.dtype}, the block {block.dtype.name}")
    if out.size < block.count:
        raise TooSmallError(f"{block.count} elements")
    out.ravel()[: block.count] = block.data
    return block.count


def decode_dictionary(data: bytes, at: int = 0) -> tuple[list[bytes], np.ndarray]:
    """Dictionary and checked indices of a string block, not materialised."""
    r = read_record(data, at)
    if r.model != DICT_1D:
        raise BlockError("not a dictionary block")
    words, codes = Dict.entries(r.side), residual(r).residual
    if len(codes) != _fits(r.shape) or len(codes) and int(codes.max()) >= len(words):
        raise CorruptError("dictionary index")
    return words, codes
