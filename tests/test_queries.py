"""Every registered query of the engine against its SQL, and the Spark surfaces around them."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions import expr as X
from blockweave.operators import blocks as B
from blockweave.operators import columnar as C
from blockweave.operators import models as M
from blockweave.plans import catalog
from blockweave.spec import CodecSpec
from blockweave.types import DType


def rows(names, found):
    def cell(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(cell(r[names.index(n)]) for n in sorted(names)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_wrapping_at_the_ends(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(0, 0, high), (0, 1, low), (0, 2, high), (0, 3, 0)], "blk long, i long, v long")
    r = C.delta(df)
    assert [x.r for x in r.orderBy("i").collect()] == [high, 1, -1, -high]
    assert [x.v for x in C.undelta(r.select("blk", "i", "r")).orderBy("i").collect()] == [high, low, high, 0]
    z = df.select("v", X.unzigzag(X.zigzag(F.col("v"))).alias("w"), X.varint_size(X.zigzag(F.col("v"))).alias("n")).collect()
    assert all(x.v == x.w for x in z) and {x.n for x in z} == {1, 10}


def test_nulls_come_back(spark):
    df = spark.createDataFrame([(0, 0, 1.5, "a"), (0, 1, None, None), (0, 2, -0.0, "")], "blk long, i long, v double, s string")
    out = B.decode(B.encode(df, CodecSpec(M.DELTA_1D)), DType.F64).orderBy("i").collect()
    assert [x.v for x in out] == [1.5, None, 0.0] and np.signbit(out[2].v)
    text = B.decode(B.encode(df, CodecSpec(M.DICT_1D), value="s"), DType.STRING).orderBy("i").collect()
    assert [x.v and bytes(x.v) for x in text] == [b"a", None, b""]


def test_data_source(spark, sf, tmp_path):
    from blockweave.sources.table import inspect_table, install, schema_of

    install(spark)
    path = str(tmp_path / "t")
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.coalesce(1).sortWithinPartitions("event_id").write.format("blockstore").option("rows", 100).mode("append").save(path)
    assert spark.read.format("blockstore").load(path).exceptAll(e).isEmpty()
    pruned = spark.read.format("blockstore").load(path).where("event_id < 150")
    assert pruned.count() == 150 and pruned.rdd.getNumPartitions() == 2
    plain = spark.read.format("blockstore_plain").option("high.event_id", 149).load("file://" + path)
    assert plain.count() == 200 and plain.rdd.getNumPartitions() == 2
    assert schema_of(path)["value"].metadata["dtype"] == "F64"
    assert inspect_table(spark, path).where("name = 'value'").count() == -(-e.count() // 100)
    e.limit(10).write.format("blockstore").mode("overwrite").save(path)
    assert spark.read.format("blockstore").load(path).count() == 10


def test_widening_leaves_no_mixture(spark, tmp_path):
    from blockweave.errors import ContainerIOError
    from blockweave.sources.table import Folder, install, widen_table

    install(spark)
    path = str(tmp_path / "t")
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    df.repartition(3).write.format("blockstore").option("rows", 50).option("bytes", 2000).mode("append").save(path)
    before = Folder(path).containers()
    assert len(before) > 3 and all(len(groups) >= 1 for _, groups in before.values())
    with pytest.raises(Exception, match="a value for every row"):
        widen_table(spark, path, df.where("id < 990").select("id", (F.col("id") + 1).alias("w")), "id")
    assert Folder(path).containers().keys() == before.keys() and spark.read.format("blockstore").load(path).count() == 1000
    assert widen_table(spark, path, df.select("id", (F.col("id") + 1).alias("w")), "id") == len(before)
    got = spark.read.format("blockstore").load(path)
    assert got.columns == ["id", "v", "w"] and got.where("w = id + 1 AND v = 2 * id").count() == 1000
    assert not Folder(path).containers().keys() & before.keys()
    with pytest.raises(ContainerIOError):
        Folder("nowhere://x/y")


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("k"))
    got = C.numbered(df, ["k"], 100, 5).select((F.col("blk") * 100 + F.col("i")).alias("n"), "k").orderBy("n").collect()
    assert [(r.n, r.k) for r in got] == [(i, 7 * i) for i in range(1000)]


def test_stream(spark, sf, tmp_path):
    from blockweave.sources.record import decode_block
    from blockweave.streaming.pushpull import encode_stream

    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("part", F.col("event_id") % 2).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = encode_stream(stream, "part", "user_id", DType.I64, CodecSpec(M.DELTA_1D), 50, "event_id").writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("records").collect()
    assert got and all(r.n == 50 for r in got)
    values = sorted(v for r in got for v in decode_block(bytes(r.record)).data.tolist())
    every = sorted(r.user_id for r in spark.read.parquet(src).collect())
    left = list(every)
    for v in values:
        left.remove(v)
    assert len(left) < 100


def test_decoding_a_stream(spark, tmp_path):
    from blockweave.sources.record import encode_block
    from blockweave.streaming.pushpull import decode_stream
    from blockweave.types import Block

    rng = np.random.default_rng(5)
    values = {k: rng.integers(0, 1000, 400) for k in range(4)}
    values[0][3] = 2**62 + 1
    records = {k: [encode_block(Block(v[a : a + 90].astype(np.int64), DType.I64), CodecSpec(M.DELTA_1D)) for a in range(0, 400, 90)] for k, v in values.items()}
    records[2][1] = b"\xff" * 8 + records[2][1][8:]
    whole = {k: b"".join(r) for k, r in records.items()}
    whole[3] = whole[3][:-5]
    rows = [(k, n, d[a : a + 131], a + 131 >= len(d)) for k, d in whole.items() for n, a in enumerate(range(0, len(d), 131))]
    src, most = str(tmp_path / "in"), max(r[1] for r in rows)
    for lo in range(0, most + 1, 11):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 11], "k int, n long, data binary, last boolean").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k int, n long, data binary, last boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    q = decode_stream(stream, "k", "data", DType.I64, "n", "last").writeStream.format("memory").queryName("decoded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {k: [] for k in whole}
    for r in spark.table("decoded").orderBy("k", "block", F.col("i").asc_nulls_last()).collect():
        got[r.k].append((r.v, r.error))
    for k in (0, 1):
        assert [v for v, _ in got[k]] == values[k].tolist() and all(e is None for _, e in got[k])
    for k in (2, 3):
        ok = [v for v, e in got[k] if e is None]
        assert ok == values[k][: len(ok)].tolist() and [e is not None for _, e in got[k]] == [False] * len(ok) + [True]
    assert len(got[3]) == 361 and len(got[2]) == 91
