"""Round trips, golden vectors, rejections and corruption of block records."""

import io
import itertools

import numpy as np
import pytest

from blockweave import errors, registry
from blockweave.operators import entropy as E
from blockweave.operators import lz
from blockweave.operators import models as M
from blockweave.operators import transforms as R
from blockweave.plans.samples import XorCoder
from blockweave.sources.container import Column, Reader, Writer, compute_stats, inspect, may_hold, pack_schema, unpack_schema, widen
from blockweave.sources.record import decode_block, decode_dictionary, decode_into, encode_block, peek, read_record
from blockweave.spec import CodecSpec
from blockweave.streaming.pushpull import PushDecoder, PushEncoder
from blockweave.types import Block, DType, Layout

RNG = np.random.default_rng(5)
SHAPES = {
    Layout.VECTOR_1D: [(0,), (1,), (7,), (100,)],
    Layout.RASTER_2D: [(1, 1), (1, 5), (5, 1), (13, 17), (0, 3)],
    Layout.STACK_2D: [(3, 4, 5), (1, 7, 3), (0, 2, 2)],
    Layout.VOLUME_3D: [(4, 5, 6), (1, 1, 1), (1, 5, 4), (0, 1, 1)],
}


def random_block(dtype, layout, shape):
    n = int(np.prod(shape))
    if dtype is DType.STRING:
        return Block([bytes(RNG.integers(97, 100, RNG.integers(0, 4)).tolist()) for _ in range(n)], dtype, layout, shape)
    return Block(np.frombuffer(RNG.bytes(n * dtype.size), dtype.numpy), dtype, layout, shape)


def raw(block):
    return list(block.data) if block.dtype is DType.STRING else block.data.tobytes()


def kinds(model):
    if model in (M.PRED_2D, M.STACK_2D):
        return [{"kind": k, "inter_slice": bool(i)} for k in range(5) for i in (0, 1)]
    return [{"kind": k} for k in range(7)] if model == M.PRED_3D else [{}]


@pytest.mark.parametrize("model", [m for m in M.MODELS if m != M.QUANTIZE_PRED_2D])
def test_models_round_trip(model):
    for dtype in M.MODELS[model].dtypes:
        for layout in M.MODELS[model].layouts:
            for shape in SHAPES[layout]:
                for params in kinds(model):
                    block = random_block(dtype, layout, shape)
                    for chain in (((), ()), ((R.BIT_SHUFFLE,), (E.HUFFMAN,)), ((R.BYTE_SHUFFLE,), (E.LZ, E.FSE))):
                        got = decode_block(encode_block(block, CodecSpec(model, *chain, params)))
                        assert raw(got) == raw(block) and got.shape == block.shape


def test_golden_record():
    data = encode_block(Block(np.arange(100, 116), DType.I16), CodecSpec(M.DELTA_1D, (R.ZIGZAG,)))
    assert len(data) == 112 and data[80:] == b"\xc8\0" + b"\x02\0" * 15
    assert data[:12] == b"BLKB" + bytes([2, 0, 0, 0, 2, 0, 2, 0])


def test_golden_vectors():
    z = R.ZigZag().encode(np.array([0, -1, 1, -2, 2], np.int8), DType.I8, {})
    assert z.tolist() == [0, 1, 2, 3, 4]
    d = M.Delta().encode(Block(np.array([1000, 1005, 1012, 1020, 1019, 1025, 1040, 1100]), DType.I32), {})
    assert d.residual.tolist() == [1000, 5, 7, 8, -1, 6, 15, 60]
    x = M.Delta().encode(Block(np.array([3.141592653589793, 3.1416, 3.1417, 3.1418]), DType.F64), {})
    assert [f"{v:016X}" for v in x.residual.view(np.uint64)] == ["400921FB54442D18", "000000047A0CC5BF", "000003CCB2465647", "0000005B95DA2BF8"]
    b = R.ByteShuffle().encode(np.array([[i << 4 | j for j in range(8)] for i in range(4)], np.uint8).ravel(), DType.F64, {})
    assert b.tolist() == [i << 4 | j for j in range(8) for i in range(4)]


def test_float_identity():
    data = np.array([0.0, -0.0, np.nan, np.inf, 5e-324])
    for model in (M.DICT_NUMERIC_1D, M.SPARSE_ZERO_1D, M.DELTA_1D, M.DELTA2_1D, M.FPC_1D):
        assert decode_block(encode_block(Block(data, DType.F64), CodecSpec(model))).data.tobytes() == data.tobytes()
    assert len(M.SparseZero().encode(Block(data, DType.F64), {}).residual) == 4


def test_quantize():
    v = np.array([2.5, -2.5, np.nan, 1e9, -1e9, 0.49999999999999994])
    assert M.quantize(v, 1, 0, DType.I8).tolist() == [3, -3, -128, 127, -128, 0]
    spec = CodecSpec(M.QUANTIZE_PRED_2D, (), (), {"scale": 10.0})
    got = decode_block(encode_block(Block(np.arange(12) / 10, DType.F64, Layout.RASTER_2D, (3, 4)), spec))
    assert np.allclose(got.data, np.arange(12) / 10)
    chained = encode_block(Block(np.arange(5) / 2, DType.F32), CodecSpec(M.RAW, (R.QUANTIZE, R.ZIGZAG), (E.LZ,), {}, ({"scale": 2.0, "target": DType.I16},)))
    assert read_record(chained).flags & 2 and decode_block(chained).data.tolist() == [0, 0.5, 1, 1.5, 2]


def test_planes_leave_nothing():
    y, x = np.indices((64, 70))
    data = encode_block(Block(200 + 4 * y + 2 * x, DType.I32, Layout.RASTER_2D, (64, 70)), CodecSpec(M.PLANE_2D, (R.BIT_SHUFFLE,), (E.LZ,)))
    r = read_record(data)
    assert r.flags & 4 and not r.payload and (decode_block(data).data.reshape(64, 70) == 200 + 4 * y + 2 * x).all()


CASES = [b"", b"a", b"ab" * 3, bytes(1000), RNG.bytes(3000), np.arange(2000, dtype="<i4").tobytes(), b"hello world, " * 300, bytes(range(256)) * 3, b"x" * 70000 + b"abc" + b"y" * 300, RNG.integers(0, 9, 5000, dtype=np.uint8).tobytes()]


@pytest.mark.parametrize("key", list(lz.CODERS))
def test_coders(key):
    coder = lz.CODERS[key]
    for data in CASES:
        coded = coder.encode(data, {})
        assert coder.decode(coded, len(data)) == data
        for _ in range(10):
            bad = bytearray(coded)
            if bad:
                bad[RNG.integers(len(bad))] ^= 1 << RNG.integers(8)
            try:
                coder.decode(bytes(bad), len(data))
            except errors.BlockError:
                pass
    assert key in (E.NONE,) or len(coder.encode(bytes(5000), {"n_lanes": 4})) < 5000


def test_streams_of_every_form():
    coder, seen = lz.CODERS[E.LZ_STREAMS], set()
    shapes = [np.cumsum(RNG.integers(-3, 4, 2000)).astype("<f8"), RNG.integers(0, 50, 3000).astype("<u4"), np.tile(RNG.integers(0, 9, 37), 60).astype("<u2"), RNG.integers(0, 4, 5000).astype("u1")]
    for data in (x.tobytes() for x in shapes):
        for params in itertools.product((0, -1, 3), (True, False, None), (True, False), (3, 6)):
            coded = coder.encode(data, dict(zip(("level", "delta", "contexts", "min_match"), params, strict=True)))
            assert coder.decode(coded, len(data)) == data
            seen.add(coded[1])
    assert {f & b for f in seen for b in (1, 2, 4, 16)} == {0, 1, 2, 4, 16}


def test_chain_limits_and_rejections():
    with pytest.raises(errors.BlockError):
        CodecSpec(1, (2, 0, 3))
    with pytest.raises(errors.BlockError):
        CodecSpec(1, (), (1,) * 5)
    with pytest.raises(errors.UnsupportedError):
        encode_block(Block(np.arange(3), DType.I32), CodecSpec(0x99))
    with pytest.raises(errors.DTypeError):
        encode_block(Block(np.arange(3), DType.U8), CodecSpec(M.DICT_NUMERIC_1D))
    with pytest.raises(errors.LayoutError):
        encode_block(Block(np.arange(4), DType.I32), CodecSpec(M.PRED_2D))
    with pytest.raises(errors.ShapeError):
        encode_block(Block(np.arange(3), DType.I32, Layout.VECTOR_1D, (4,)))
    with pytest.raises(errors.DTypeError):
        encode_block(Block(np.arange(3), DType.U32), CodecSpec(1, (R.ZIGZAG,)))


def test_corrupt_records_raise_or_decode():
    block = random_block(DType.I32, Layout.VECTOR_1D, (200,))
    data = encode_block(block, CodecSpec(M.DELTA_1D, (R.ZIGZAG, R.BYTE_SHUFFLE), (E.LZ, E.HUFFMAN)))
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 0x41
        try:
            decode_block(bytes(bad))
        except errors.BlockError:
            pass
    for n in range(0, len(data), 7):
        with pytest.raises(errors.BlockError):
            decode_block(data[:n])


def test_validity_peek_into_and_dictionary():
    valid = np.array([True, False, True])
    data = encode_block(Block(np.array([1, 0, 3]), DType.I32, validity=valid))
    assert decode_block(data).validity.tolist() == valid.tolist()
    assert peek(data) == {"dtype": DType.I32, "layout": Layout.VECTOR_1D, "shape": (3,), "bytes": 12}
    out = np.zeros(5, np.int32)
    assert decode_into(data, out) == 3 and out.tolist() == [1, 0, 3, 0, 0]
    with pytest.raises(errors.TooSmallError):
        decode_into(data, np.zeros(2, np.int32))
    words, codes = decode_dictionary(encode_block(Block([b"b", b"a\0", b"", b"b"], DType.STRING), CodecSpec(M.DICT_1D)))
    assert words == [b"b", b"a\0", b""] and codes.tolist() == [0, 1, 2, 0]


def test_plugins():
    registry.clear()
    registry.register("entropy", 0xFF00, XorCoder(7))
    for bad in (("entropy", 0xFF00, XorCoder(1)), ("entropy", 5, XorCoder(1)), ("model", 0xFF01, XorCoder(1))):
        with pytest.raises(errors.BlockError):
            registry.register(*bad)
    data = encode_block(Block(np.arange(9), DType.I64), CodecSpec(1, (), (0xFF00,)))
    assert decode_block(data).data.tolist() == list(range(9))
    registry.clear()
    with pytest.raises(errors.UnsupportedError):
        decode_block(data)


def container(groups=3):
    f = io.BytesIO()
    w = Writer(f, [Column("t", DType.F64, "degrees"), Column("p", DType.I32)])
    for g in range(groups):
        blocks = [Block(g * 100 + np.arange(64) * 0.5, DType.F64), Block(np.arange(64) - g, DType.I32)]
        for b in blocks:
            w.write_block(b, CodecSpec(M.DELTA_1D, (R.BYTE_SHUFFLE,), (E.LZ,)))
        w.set_stats([compute_stats(b) for b in blocks])
        w.end_group(64)
    w.close()
    return f


def test_container_scan_and_statistics():
    r = Reader(container())
    assert [(c.name, c.annotation) for c in r.schema] == [("t", "degrees"), ("p", "")] and r.block_count == 6
    assert r.stats(1, 0).values(DType.F64) == (100.0, 131.5)
    assert [g for g, _ in r.project(["p"], {"t": (120, 130)})] == [1]
    assert r.block(2, 1).data[0] == -2 and len(list(r.blocks())) == 6
    s = compute_stats(Block(np.array([-0.0, 0.0]), DType.F64)).values(DType.F64)
    assert np.signbit(s[0]) and not np.signbit(s[1])
    text = compute_stats(Block([b"prefix-long-b", b"prefix-long-a"], DType.STRING))
    assert may_hold(text, DType.STRING, "prefix-long-z", None) and not may_hold(text, DType.STRING, "q", None) and not may_hold(text, DType.STRING, None, "a")


def test_widening_and_crash():
    f = container()
    before = f.getvalue()
    cells = [[(Block(-7 * np.arange(64) - 1, DType.I32), None)] for _ in range(3)]
    widen(f, [Column("e", DType.I32, "metres")], cells)
    r = Reader(f)
    assert r.version == 2 and r.schema[-1].name == "e" and r.block(2, 2).data[2] == -15 and r.block(1, 0).data[1] == 100.5
    assert len(inspect(f)) == 9
    crashed = io.BytesIO(before[:64] + f.getvalue()[64:])  # all but the header was written
    assert len(Reader(crashed).schema) == 2 and Reader(crashed).block(0, 1).data[5] == 5
    with pytest.raises(errors.BlockError):
        list(r.blocks())
    with pytest.raises(errors.BlockError):
        widen(f, [Column("e", DType.I32)], cells)


def test_container_errors():
    f = io.BytesIO()
    w = Writer(f, [Column("a", DType.I32)])
    with pytest.raises(errors.BlockError):
        w.end_group(1)
    with pytest.raises(errors.DTypeError):
        w.write_block(Block(np.arange(2), DType.I64))
    w.write_block(Block(np.arange(2), DType.I32))
    with pytest.raises(errors.BlockError):
        w.close()
    with pytest.raises(errors.CorruptError):
        Reader(f)
    assert unpack_schema(pack_schema([Column("ä", DType.F16, "x" * 300)]))[0].name == "ä"
    for n in (1, 3, 6):
        with pytest.raises(errors.CorruptError):
            unpack_schema(pack_schema([Column("abc", DType.I8)])[:n])
    data = container().getvalue()
    for n in (0, 63, 200, len(data) - 1):
        with pytest.raises(errors.BlockError):
            Reader(io.BytesIO(data[:n]))


def test_push_and_pull():
    data = RNG.integers(0, 99, 1000).astype("<i4")
    e, d, got = PushEncoder(DType.I32, CodecSpec(M.DELTA_1D), 128), PushDecoder(), []
    for at in range(0, data.nbytes, 33):
        e.push(data.tobytes()[at : at + 33])
    assert e.checkpoint() == {"blocks": 7, "bytes": 7 * 512}
    e.finish()
    more = True
    while more:
        part, more = e.pull(50)
        d.push(part)
        while (b := d.next()[0]) is not None:
            got += b.data.tolist()
    d.finish()
    assert got == data.tolist() and d.next() == (None, True) and d.checkpoint()["blocks"] == 8
    bad = PushDecoder()
    bad.push(b"junk" * 40)
    for _ in range(2):
        with pytest.raises(errors.CorruptError):
            bad.next()
    short = PushEncoder(DType.I32)
    short.push(b"abc")
    with pytest.raises(errors.BlockError):
        short.finish()
