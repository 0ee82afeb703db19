"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave import registry
from blockweave.functions import expr as X
from blockweave.operators import blocks as B
from blockweave.operators import columnar as C
from blockweave.operators import entropy as E
from blockweave.operators import models as M
from blockweave.operators import transforms as R
from blockweave.shared import shared_dir
from blockweave.spec import CodecSpec
from blockweave.types import DType, Layout

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ROWS = 1024


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = " ".join(oracle.split())
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for a container table in the shared folder."""
    return f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, value: str = "user_id") -> DataFrame:
    return C.dense_blocks(read(spark, sf_dir, "events"), "event_id", ROWS).select("blk", "i", F.col(value).alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as integer rasters of 64 rows a block."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.expr("vec_id div 64").alias("blk"), F.pmod("vec_id", F.lit(64)).alias("y"), F.col("x").cast("bigint").alias("x"), F.floor(F.col("e").cast("double") * 1024).cast("int").alias("v"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers as volumes of 8 x 8 x 64."""
    return grid(spark, sf_dir).select("blk", F.expr("y div 8").alias("z"), F.pmod("y", F.lit(8)).alias("y"), "x", "v")


EV = f"ev AS (SELECT event_id // {ROWS} AS blk, event_id % {ROWS} AS i, user_id, value, event_type FROM events)"
GRID = "g AS (SELECT vec_id // 64 AS blk, vec_id % 64 AS y, x, CAST(floor(1024 * CAST(embedding[x + 1] AS DOUBLE)) AS INT) AS v FROM embeddings, range(64) r(x))"
VOLUME = f"{GRID}, vol AS (SELECT blk, y // 8 AS z, y % 8 AS y, x, v FROM g)"
NEAR2 = """l AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY blk, y ORDER BY x), 0) AS a FROM g),
    n AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY blk, x ORDER BY y), 0) AS b, coalesce(lag(a) OVER (PARTITION BY blk, x ORDER BY y), 0) AS c FROM l)"""
PAETH2 = "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"
NEAR3 = """p1 AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY blk, z, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY blk, z, x ORDER BY y), 0) AS b, coalesce(lag(v) OVER (PARTITION BY blk, y, x ORDER BY z), 0) AS c FROM vol),
    p2 AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY blk, z, x ORDER BY y), 0) AS ab, coalesce(lag(a) OVER (PARTITION BY blk, y, x ORDER BY z), 0) AS ac, coalesce(lag(b) OVER (PARTITION BY blk, y, x ORDER BY z), 0) AS bc FROM p1),
    n AS (SELECT *, coalesce(lag(ab) OVER (PARTITION BY blk, y, x ORDER BY z), 0) AS abc, a + b + c - ab - ac - bc + coalesce(lag(ab) OVER (PARTITION BY blk, y, x ORDER BY z), 0) AS p, CAST(x > 0 AS INT) + CAST(y > 0 AS INT) + CAST(z > 0 AS INT) AS k FROM p2)"""


def paeth_sql(a: str, b: str, c: str, p: str) -> str:
    return f"CASE WHEN abs({p} - {a}) <= abs({p} - {b}) AND abs({p} - {a}) <= abs({p} - {c}) THEN {a} WHEN abs({p} - {b}) <= abs({p} - {c}) THEN {b} ELSE {c} END"


# --- one-dimensional models and transforms -------------------------------------------------------------------


@query(f"WITH {EV} SELECT blk, i, user_id AS v FROM ev")
def raw_1d(spark, sf_dir):
    return events(spark, sf_dir)


@query(f"WITH {EV} SELECT blk, i, user_id - coalesce(lag(user_id) OVER (PARTITION BY blk ORDER BY i), 0) AS r FROM ev")
def delta_1d_i64(spark, sf_dir):
    return C.delta(events(spark, sf_dir)).select("blk", "i", "r")


@query(f"WITH {EV} SELECT blk, i, user_id AS v FROM ev")
def delta_1d_decode(spark, sf_dir):
    return C.undelta(C.delta(events(spark, sf_dir)).select("blk", "i", "r")).select("blk", "i", "v")


@query(f"""WITH {EV}, d AS (SELECT blk, i, user_id - coalesce(lag(user_id) OVER (PARTITION BY blk ORDER BY i), 0) AS r FROM ev)
    SELECT blk, i, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM d""")
def zigzag(spark, sf_dir):
    return C.delta(events(spark, sf_dir)).select("blk", "i", X.zigzag(F.col("r")).alias("u"))


@query(f"WITH {EV} SELECT blk, i, user_id - coalesce(lag(user_id) OVER (PARTITION BY blk ORDER BY i), 0) AS r FROM ev")
def zigzag_decode(spark, sf_dir):
    coded = C.delta(events(spark, sf_dir)).select("blk", "i", X.zigzag(F.col("r")).alias("u"))
    return coded.select("blk", "i", X.unzigzag(F.col("u")).alias("r"))


@query(f"WITH {EV} SELECT blk, i, -user_id - 1 AS r FROM ev")
def complement(spark, sf_dir):
    return events(spark, sf_dir).select("blk", "i", X.complement(F.col("v")).alias("r"))


_Q = "CASE WHEN isnan(value) THEN -32768 ELSE CAST(greatest(least(sign((value - 50) * 10) * floor(abs((value - 50) * 10) + 0.5), 32767), -32768) AS INT) END"


@query(f"WITH {EV} SELECT blk, i, {_Q} AS q FROM ev")
def quantize(spark, sf_dir):
    return events(spark, sf_dir, "value").select("blk", "i", X.quantize(F.col("v"), 10, 50, -32768, 32767).alias("q"))


@query(f"WITH {EV} SELECT blk, i, {_Q} * 0.1::DOUBLE + 50 AS v FROM ev")
def dequantize(spark, sf_dir):
    q = X.quantize(F.col("v"), 10, 50, -32768, 32767)
    return events(spark, sf_dir, "value").select("blk", "i", X.dequantize(q, 10, 50).alias("v"))


_DICT = f"""WITH {EV}, w AS (SELECT blk, event_type AS v, row_number() OVER (PARTITION BY blk ORDER BY min(i)) - 1 AS code FROM ev GROUP BY blk, event_type)"""


@query(f"{_DICT} SELECT blk, CAST(code AS INT) AS code, v FROM w")
def dict_1d_dictionary(spark, sf_dir):
    return C.dictionary(events(spark, sf_dir, "event_type"))


@query(f"{_DICT} SELECT blk, i, CAST(code AS INT) AS code FROM ev JOIN w USING (blk) WHERE event_type = v")
def dict_1d_codes(spark, sf_dir):
    return C.dictionary_codes(events(spark, sf_dir, "event_type"))


@query(f"WITH {EV} SELECT blk, i, event_type AS v FROM ev")
def dict_1d_decode(spark, sf_dir):
    df = events(spark, sf_dir, "event_type")
    return C.from_dictionary(C.dictionary_codes(df), C.dictionary(df)).select("blk", "i", "v")


@query(f"WITH {EV} SELECT blk, i, event_type AS v FROM ev WHERE event_type LIKE 'p%'")
def dict_deferred_filter(spark, sf_dir):
    """The predicate runs on the dictionary, not on the rows."""
    df = events(spark, sf_dir, "event_type")
    return C.from_dictionary(C.dictionary_codes(df), C.dictionary(df).where("v LIKE 'p%'")).select("blk", "i", "v")


@query(f"""WITH o AS (SELECT o_orderkey // {ROWS} AS blk, o_orderkey AS i, o_custkey AS v FROM orders),
    w AS (SELECT blk, v, row_number() OVER (PARTITION BY blk ORDER BY min(i)) - 1 AS code FROM o GROUP BY blk, v)
    SELECT blk, i, CAST(code AS INT) AS code FROM o JOIN w USING (blk, v)""")
def dict_numeric_codes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {ROWS}").alias("blk"), F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))
    return C.dictionary_codes(o)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dense_blocks(read(spark, sf_dir, "labels"), "doc_id", ROWS).select("blk", "i", F.col("toxic").alias("v"))


_LABELS = f"l AS (SELECT doc_id // {ROWS} AS blk, doc_id % {ROWS} AS i, toxic AS v FROM labels)"


@query(f"WITH {_LABELS} SELECT * FROM l WHERE v <> 0")
def sparse_zero_entries(spark, sf_dir):
    return C.sparse_entries(_labels(spark, sf_dir))


@query(f"WITH {_LABELS}, s AS (SELECT blk, max(i) + 1 AS n FROM l GROUP BY blk), p AS (SELECT blk, unnest(range(n)) AS i FROM s) SELECT blk, i, coalesce(v, 0) AS v FROM p LEFT JOIN l USING (blk, i)")
def sparse_zero_decode(spark, sf_dir):
    df = _labels(spark, sf_dir)
    return C.from_sparse(C.sparse_entries(df), df.groupBy("blk").agg((F.max("i") + 1).alias("n")))


@query(f"""WITH {_LABELS}, f AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY blk ORDER BY i) = v THEN 0 ELSE 1 END AS f FROM l),
    r AS (SELECT *, sum(f) OVER (PARTITION BY blk ORDER BY i) - 1 AS run FROM f)
    SELECT blk, CAST(run AS BIGINT) AS run, min(i) AS first, count(*) AS n, min(v) AS v FROM r GROUP BY blk, run""")
def rle_runs(spark, sf_dir):
    return C.runs(_labels(spark, sf_dir))


@query(f"WITH {EV} SELECT blk, i, event_type AS v FROM ev")
def rle_decode(spark, sf_dir):
    return C.from_runs(C.runs(events(spark, sf_dir, "event_type")))


@query(f"""WITH {EV}, d AS (SELECT blk, i, user_id - coalesce(lag(user_id) OVER (PARTITION BY blk ORDER BY i), 0) AS r FROM ev), z AS (SELECT blk, i, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM d)
    SELECT blk, i, CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 ELSE 4 END AS size FROM z""")
def varint_size(spark, sf_dir):
    return C.delta(events(spark, sf_dir)).select("blk", "i", X.varint_size(X.zigzag(F.col("r"))).alias("size"))


# --- rasters, stacks and volumes -----------------------------------------------------------------------------

for _kind, _p in {"left": "a", "up": "b", "average": "CAST(trunc((a + b) / 2) AS INT)", "paeth": PAETH2}.items():

    def _encode2d(spark, sf_dir, kind=_kind):
        return C.predict2d(grid(spark, sf_dir), kind).select("blk", "y", "x", "r")

    _encode2d.__name__ = f"pred2d_{_kind}"
    query(f"WITH {GRID}, {NEAR2} SELECT blk, y, x, CAST(v - {_p} AS BIGINT) AS r FROM n")(_encode2d)

for _kind in ("left", "up"):

    def _decode2d(spark, sf_dir, kind=_kind):
        return C.unpredict2d(C.predict2d(grid(spark, sf_dir), kind).select("blk", "y", "x", "r"), kind).select("blk", "y", "x", "v")

    _decode2d.__name__ = f"pred2d_{_kind}_decode"
    query(f"WITH {GRID} SELECT blk, y, x, CAST(v AS BIGINT) AS v FROM g")(_decode2d)


@query(f"""WITH {GRID}, {NEAR2}, s AS (SELECT blk, sum(abs(v - a)) AS l, sum(abs(v - b)) AS u, sum(abs(v - CAST(trunc((a + b) / 2) AS INT))) AS av, sum(abs(v - {PAETH2})) AS pa FROM n GROUP BY blk)
    SELECT blk, CASE least(l, u, av, pa) WHEN l THEN 'left' WHEN u THEN 'up' WHEN av THEN 'average' ELSE 'paeth' END AS kind, CAST(least(l, u, av, pa) AS BIGINT) AS cost FROM s""")
def pred2d_auto_kind(spark, sf_dir):
    return C.choose2d(grid(spark, sf_dir), 64).select("blk", "kind", F.least("left", "up", "average", "paeth").cast("bigint").alias("cost"))


_T = "tile AS (SELECT *, y // 32 AS ty, x // 32 AS tx, y % 32 AS ly, x % 32 AS lx FROM g)"
_FIT = f"""{_T}, m AS (SELECT blk, ty, tx, CAST(count(*) AS DOUBLE) AS n, CAST(max(lx) + 1 AS DOUBLE) AS w, CAST(max(ly) + 1 AS DOUBLE) AS h, CAST(sum(v) AS DOUBLE) AS sv, CAST(sum(v * lx) AS DOUBLE) AS sx, CAST(sum(v * ly) AS DOUBLE) AS sy FROM tile GROUP BY blk, ty, tx),
    d AS (SELECT *, CASE WHEN w > 1 THEN (sx - sv * ((w - 1) / 2)) / (n * (w * w - 1) / 12) ELSE 0 END AS fb, CASE WHEN h > 1 THEN (sy - sv * ((h - 1) / 2)) / (n * (h * h - 1) / 12) ELSE 0 END AS fc FROM m),
    f AS (SELECT blk, ty, tx, sv / n - fb * ((w - 1) / 2) - fc * ((h - 1) / 2) AS a, fb AS b, fc AS c FROM d),
    co AS (SELECT blk, ty, tx, CAST(sign(a) * floor(abs(a) * 256 + 0.5) AS BIGINT) AS a, CAST(sign(b) * floor(abs(b) * 256 + 0.5) AS BIGINT) AS b, CAST(sign(c) * floor(abs(c) * 256 + 0.5) AS BIGINT) AS c FROM f)"""


@query(f"WITH {GRID}, {_FIT} SELECT * FROM co")
def plane2d_coeffs(spark, sf_dir):
    return C.plane_coefficients(grid(spark, sf_dir))


@query(f"WITH {GRID}, {_FIT}, s AS (SELECT blk, y, x, v, a + b * lx + c * ly AS s FROM tile JOIN co USING (blk, ty, tx)) SELECT blk, y, x, v - CAST(sign(s) * ((abs(s) + 128) // 256) AS BIGINT) AS r FROM s")
def plane2d_residual(spark, sf_dir):
    return C.plane_residual(grid(spark, sf_dir))


@query(f"WITH {VOLUME} SELECT blk, z, y, x, CAST(v - coalesce(lag(v) OVER (PARTITION BY blk, y, x ORDER BY z), 0) AS BIGINT) AS r FROM vol")
def stack2d_inter_slice(spark, sf_dir):
    return C.interslice(volume(spark, sf_dir)).select("blk", "z", "y", "x", "r")


@query(f"""WITH {VOLUME}, l AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY blk, z, y ORDER BY x), 0) AS a FROM vol),
    n AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY blk, z, x ORDER BY y), 0) AS b, coalesce(lag(a) OVER (PARTITION BY blk, z, x ORDER BY y), 0) AS c FROM l) SELECT blk, z, y, x, CAST(v - {PAETH2} AS BIGINT) AS r FROM n""")
def stack2d_paeth(spark, sf_dir):
    return C.predict2d(volume(spark, sf_dir), "paeth", part=("blk", "z")).select("blk", "z", "y", "x", "r")


@query("""WITH q AS (SELECT vec_id // 64 AS blk, vec_id % 64 AS y, x, CAST(greatest(least(sign(e * 100) * floor(abs(e * 100) + 0.5), 32767), -32768) AS INT) AS q FROM (SELECT vec_id, x, CAST(embedding[x + 1] AS DOUBLE) AS e FROM embeddings, range(64) r(x)))
    SELECT blk, y, x, CAST(q - coalesce(lag(q) OVER (PARTITION BY blk, x ORDER BY y), 0) AS BIGINT) AS r FROM q""")
def quantize_pred2d(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    q = e.select(F.expr("vec_id div 64").alias("blk"), F.pmod("vec_id", F.lit(64)).alias("y"), F.col("x").cast("bigint").alias("x"), X.quantize(F.col("e").cast("double"), 100, 0, -32768, 32767).alias("v"))
    return C.predict2d(q, "up").select("blk", "y", "x", "r")


_P3 = {
    "left": "a",
    "up": "b",
    "front": "c",
    "avg3": "CASE k WHEN 3 THEN CAST(trunc((a + b + c) / 3) AS INT) WHEN 2 THEN CAST(trunc((a + b + c) / 2) AS INT) ELSE a + b + c END",
    "grad3d": "p",
    "paeth3d": f"CASE k WHEN 3 THEN {paeth_sql('a', 'b', 'c', 'p')} WHEN 2 THEN CASE WHEN z = 0 THEN {paeth_sql('a', 'b', 'ab', '(a + b - ab)')} WHEN y = 0 THEN {paeth_sql('a', 'c', 'ac', '(a + c - ac)')} ELSE {paeth_sql('b', 'c', 'bc', '(b + c - bc)')} END ELSE a + b + c END",
}
for _kind, _p in _P3.items():

    def _encode3d(spark, sf_dir, kind=_kind):
        return C.predict3d(volume(spark, sf_dir), kind).select("blk", "z", "y", "x", "r")

    _encode3d.__name__ = f"pred3d_{_kind}"
    query(f"WITH {VOLUME}, {NEAR3} SELECT blk, z, y, x, CAST(v - ({_p}) AS BIGINT) AS r FROM n")(_encode3d)


@query(f"WITH {VOLUME} SELECT blk, z, y, x, CAST(v AS BIGINT) AS v FROM vol")
def pred3d_grad3d_decode(spark, sf_dir):
    return C.ungrad3d(C.predict3d(volume(spark, sf_dir), "grad3d").select("blk", "z", "y", "x", "r")).select("blk", "z", "y", "x", "v")


# --- statistics, choices, scans ------------------------------------------------------------------------------

_LANES = f"WITH {EV}, h AS (SELECT CAST(lane AS INT) AS lane, (user_id >> CAST(8 * lane AS INT)) & 255 AS byte, count(*) AS n FROM ev, range(8) r(lane) GROUP BY 1, 2)"


@query(f"{_LANES} SELECT * FROM h")
def lane_histogram(spark, sf_dir):
    return C.byte_histogram(events(spark, sf_dir))


@query(f"""{_LANES}, p AS (SELECT lane, n / sum(n) OVER (PARTITION BY lane) AS p FROM h), e AS (SELECT lane, -sum(p * log2(p)) AS e FROM p GROUP BY lane)
    SELECT lane, round(e, 6) AS entropy, CASE WHEN e > 7.5 THEN 'none' WHEN e < 4 THEN 'huffman' ELSE 'fse' END AS coder FROM e""")
def lane_entropy_choice(spark, sf_dir):
    return C.lane_choices(events(spark, sf_dir))


@query(f"{_LANES} SELECT byte, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY byte")
def byte_histogram(spark, sf_dir):
    return C.byte_histogram(events(spark, sf_dir)).groupBy("byte").agg(F.sum("n").alias("n"))


_ZONES = f"SELECT blk, count(*) AS rows, min(user_id) AS user_id_min, max(user_id) AS user_id_max, count(*) FILTER (user_id IS NULL) AS user_id_nulls, min(value) AS value_min, max(value) AS value_max, count(*) FILTER (value IS NULL) AS value_nulls FROM (SELECT *, event_id // {ROWS} AS blk FROM events) GROUP BY blk"


def _zones(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return C.zone_map(C.dense_blocks(read(spark, sf_dir, "events"), "event_id", ROWS), columns)


@query(_ZONES)
def zone_map(spark, sf_dir):
    return _zones(spark, sf_dir, ["user_id", "value"])


@query(f"SELECT DISTINCT event_id // {ROWS} AS blk FROM events WHERE event_id // {ROWS} BETWEEN 3000 // {ROWS} AND 5000 // {ROWS}")
def zone_map_prune(spark, sf_dir):
    return C.prune(_zones(spark, sf_dir, ["event_id"]), "event_id", 3000, 5000).select("blk")


@query("SELECT event_id, user_id, value FROM events WHERE event_id BETWEEN 300 AND 5000")
def flagship_events_scan(spark, sf_dir):
    """Zone-map pruning by a range, from the one column that it needs; then only blocks that are left are read
    whole, delta and zigzag coded and decoded."""
    e = C.dense_blocks(read(spark, sf_dir, "events"), "event_id", ROWS)
    keep = C.prune(C.zone_map(e.select("blk", "event_id"), ["event_id"]), "event_id", 300, 5000).select("blk")
    left = e.join(keep, "blk", "left_semi").withColumnRenamed("user_id", "v")
    coded = C.delta(left).select("blk", "i", "event_id", "value", X.zigzag(F.col("r")).alias("u"))
    found = C.undelta(coded.withColumn("r", X.unzigzag(F.col("u"))))
    return found.where("event_id BETWEEN 300 AND 5000").select("event_id", F.col("v").alias("user_id"), "value")


@query("SELECT event_id, value, (r - 1) // 1000 AS blk, (r - 1) % 1000 AS i FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS r FROM events)")
def block_split(spark, sf_dir):
    """Blocks by position in a total order, as push streams cut them: each row's block and place."""
    return C.numbered(read(spark, sf_dir, "events").select("event_id", "value"), ["value", "event_id"], 1000)


@query("SELECT column_name AS column, round(d / n, 6) AS distinct_share, round(z / n, 6) AS zero_share, CASE WHEN z / n >= 0.75 THEN 'sparse_zero' WHEN d / n < 0.05 THEN 'dict_numeric' WHEN d / n < 0.1 THEN 'dict_numeric or raw' ELSE 'raw' END AS model FROM (SELECT 'l_discount' AS column_name, count(DISTINCT l_discount) AS d, count(*) FILTER (l_discount = 0) AS z, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), count(*) FILTER (l_quantity = 0), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), count(*) FILTER (l_extendedprice = 0), count(*) FROM lineitem)")
def cardinality_advice(spark, sf_dir):
    return C.advice(read(spark, sf_dir, "lineitem"), ["l_discount", "l_quantity", "l_extendedprice"])


# --- round trips through encoded bytes -----------------------------------------------------------------------

_PLAIN = f"WITH {EV} SELECT blk, i, {{}} AS v FROM ev"


def _round_trip(name: str, value: str, spec: CodecSpec, dtype: DType) -> None:
    def run(spark, sf_dir):
        return B.decode(B.encode(events(spark, sf_dir, value), spec, dtype=dtype), dtype)

    run.__name__ = name
    query(_PLAIN.format(value))(run)


_F64 = {"rt_delta_f64": M.DELTA_1D, "rt_delta2_f64": M.DELTA2_1D, "rt_fpc_f64": M.FPC_1D, "rt_dict_numeric_f64": M.DICT_NUMERIC_1D, "rt_sparse_zero_f64": M.SPARSE_ZERO_1D, "rt_raw_f64": M.RAW}
for _name, _model in _F64.items():
    _round_trip(_name, "value", CodecSpec(_model, (R.BYTE_SHUFFLE,), (E.LZ,)), DType.F64)
_round_trip("rt_byte_shuffle", "value", CodecSpec(M.RAW, (R.BYTE_SHUFFLE,)), DType.F64)
_round_trip("rt_bit_shuffle", "value", CodecSpec(M.RAW, (R.BIT_SHUFFLE,)), DType.F64)
_CODERS = {"rt_deflate": E.DEFLATE, "rt_huffman": E.HUFFMAN, "rt_huffman4": E.HUFFMAN4, "rt_fse": E.FSE, "rt_lane": E.LANE, "rt_lz": E.LZ, "rt_lz_opt": E.LZ_OPT, "rt_lz_split": E.LZ_SPLIT, "rt_lz_streams": E.LZ_STREAMS}
for _name, _coder in _CODERS.items():
    _round_trip(_name, "user_id", CodecSpec(M.DELTA_1D, (R.ZIGZAG, R.BYTE_SHUFFLE), (_coder,), {}, (), ({"n_lanes": 8},)), DType.I64)
_round_trip("rt_chain_lz_huffman", "user_id", CodecSpec(M.DELTA_1D, (R.ZIGZAG, R.BYTE_SHUFFLE), (E.LZ, E.HUFFMAN)), DType.I64)


@query(_PLAIN.format("event_type"))
def rt_dict_string(spark, sf_dir):
    coded = B.encode(events(spark, sf_dir, "event_type"), CodecSpec(M.DICT_1D, (R.BYTE_SHUFFLE,), (E.LZ,)))
    return B.decode(coded, DType.STRING).select("blk", "i", F.col("v").cast("string").alias("v"))


def _raster_trip(name: str, source: Callable, order: tuple[str, ...], layout: Layout, spec: CodecSpec, dtype: DType = DType.I32) -> None:
    """All blocks, the last one with the extent that it has; cells of that extent that no row has are null."""

    def run(spark, sf_dir):
        return B.decode(B.encode(source(spark, sf_dir), spec, order, layout=layout, dtype=dtype), dtype, order)

    run.__name__ = name
    cells = "".join(f", unnest(range(top_{c} + 1)) u_{c}({c})" for c in order)
    extent = f"x AS (SELECT blk, {', '.join(f'max({c}) AS top_{c}' for c in order)} FROM {{0}} GROUP BY blk)"
    sql = f"WITH {VOLUME}, {extent}, cells AS (SELECT blk, {', '.join(order)} FROM x{cells}) SELECT blk, {', '.join(order)}, {{1}} AS v FROM cells LEFT JOIN {{0}} USING (blk, {', '.join(order)})"
    of = "vol" if len(order) == 3 else "g"
    query(sql.format(of, {DType.I32: "v", DType.F32: "CAST(v * 0.25 AS FLOAT)", DType.F64: "v * 0.25::DOUBLE", DType.F16: "CAST(v % 2048 AS FLOAT)", DType.I16: "CAST(v AS SMALLINT)"}[dtype]))(run)


def _scaled(source: Callable, dtype: DType) -> Callable:
    """The same cells in another element type."""
    value = {DType.F32: "CAST(v * 0.25D AS FLOAT)", DType.F64: "v * 0.25D", DType.F16: "CAST(v % 2048 AS FLOAT)", DType.I16: "CAST(v AS SMALLINT)"}[dtype]
    return lambda spark, sf_dir: source(spark, sf_dir).withColumn("v", F.expr(value))


for _kind, _k in {"average": M.AVERAGE, "paeth": M.PAETH, "auto": M.AUTO}.items():
    _raster_trip(f"rt_pred2d_{_kind}", grid, ("y", "x"), Layout.RASTER_2D, CodecSpec(M.PRED_2D, (R.ZIGZAG, R.BYTE_SHUFFLE), (E.HUFFMAN,), {"kind": _k}))
_raster_trip("rt_plane2d", grid, ("y", "x"), Layout.RASTER_2D, CodecSpec(M.PLANE_2D, (R.ZIGZAG, R.BYTE_SHUFFLE), (E.FSE,)))
_raster_trip("rt_stack2d", volume, ("z", "y", "x"), Layout.STACK_2D, CodecSpec(M.STACK_2D, (R.BIT_SHUFFLE,), (E.LZ,), {"inter_slice": True}))
for _kind, _k in {"avg3": M.AVG3, "paeth3d": M.PAETH3D, "auto": M.AUTO}.items():
    _raster_trip(f"rt_pred3d_{_kind}", volume, ("z", "y", "x"), Layout.VOLUME_3D, CodecSpec(M.PRED_3D, (R.ZIGZAG, R.BYTE_SHUFFLE), (E.LZ,), {"kind": _k}))
for _t in (DType.F32, DType.F64, DType.F16, DType.I16):
    _n = _t.name.lower()
    _raster_trip(f"rt_pred2d_{_n}", _scaled(grid, _t), ("y", "x"), Layout.RASTER_2D, CodecSpec(M.PRED_2D, (R.BYTE_SHUFFLE,), (E.LZ,), {"kind": M.PAETH}), _t)
    _raster_trip(f"rt_stack2d_{_n}", _scaled(volume, _t), ("z", "y", "x"), Layout.STACK_2D, CodecSpec(M.STACK_2D, (R.BYTE_SHUFFLE,), (E.HUFFMAN4,), {"inter_slice": True}), _t)
    _raster_trip(f"rt_pred3d_{_n}", _scaled(volume, _t), ("z", "y", "x"), Layout.VOLUME_3D, CodecSpec(M.PRED_3D, (R.BYTE_SHUFFLE,), (E.FSE,), {"kind": M.GRAD3D}), _t)


@query("""SELECT vec_id // 64 AS blk, vec_id % 64 AS y, x, CAST(greatest(least(sign(e * 100) * floor(abs(e * 100) + 0.5), 32767), -32768) AS INT) * 0.01::DOUBLE AS v
    FROM (SELECT vec_id, x, CAST(embedding[x + 1] AS DOUBLE) AS e FROM embeddings, range(64) r(x))""")
def rt_quantize_pred2d(spark, sf_dir):
    """Lossy: decoded values are those of the quantised ones."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    cells = e.select(F.expr("vec_id div 64").alias("blk"), F.pmod("vec_id", F.lit(64)).alias("y"), F.col("x").cast("bigint").alias("x"), F.col("e").cast("double").alias("v"))
    spec = CodecSpec(M.QUANTIZE_PRED_2D, (R.ZIGZAG, R.BYTE_SHUFFLE), (E.HUFFMAN,), {"target": DType.I16, "kind": M.PAETH, "scale": 100.0, "offset": 0.0})
    return B.decode(B.encode(cells, spec, ("y", "x"), layout=Layout.RASTER_2D), DType.F64, ("y", "x"))


@query(_PLAIN.format("value"))
def rt_xor_bits(spark, sf_dir):
    """Floats as bits, XORed and restored by window functions."""
    coded = C.xor_delta(B.bit_pattern(events(spark, sf_dir, "value"))).select("blk", "i", "r")
    return B.from_bit_pattern(C.undo_xor_delta(coded).select("blk", "i", "bits")).select("blk", "i", "v")


@query(_PLAIN.format("user_id"))
def rt_plugin(spark, sf_dir):
    """A plugin coder, shipped with the tasks."""
    from blockweave.plans.samples import XorCoder

    registry.plugins()["entropy"].get(registry.FIRST) or registry.register("entropy", registry.FIRST, XorCoder(0xA5))
    return B.decode(B.encode(events(spark, sf_dir), CodecSpec(M.DELTA_1D, (R.ZIGZAG,), (registry.FIRST,))), DType.I64)


@query(_PLAIN.format("user_id"))
def rt_plugin_model(spark, sf_dir):
    from blockweave.plans.samples import Negated

    registry.plugins()["model"].get(registry.FIRST) or registry.register("model", registry.FIRST, Negated())
    return B.decode(B.encode(events(spark, sf_dir), CodecSpec(registry.FIRST, (R.BYTE_SHUFFLE,), (E.LZ,))), DType.I64)


@query(_PLAIN.format("user_id"))
def rt_plugin_transform(spark, sf_dir):
    from blockweave.plans.samples import Rotated

    registry.plugins()["transform"].get(registry.FIRST) or registry.register("transform", registry.FIRST, Rotated())
    return B.decode(B.encode(events(spark, sf_dir), CodecSpec(M.DELTA_1D, (R.ZIGZAG, registry.FIRST), (E.HUFFMAN,))), DType.I64)


@query(f"WITH {EV}, d AS (SELECT DISTINCT blk FROM ev) SELECT blk, CASE blk % 4 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 8 ELSE 0 END AS code FROM d")
def record_check(spark, sf_dir):
    """Status of records, some of which were cut short, given another version or another magic number."""
    coded = B.encode(events(spark, sf_dir), CodecSpec(M.DELTA_1D, (R.ZIGZAG,), (E.LZ,)))
    short, version, magic = F.expr("substring(record, 1, length(record) - 9)"), F.expr("concat(substring(record, 1, 4), X'0700', substring(record, 7))"), F.expr("concat(X'00', substring(record, 2))")
    kind = F.pmod("blk", F.lit(4))
    record = F.when(kind == 1, short).when(kind == 2, version).when(kind == 3, magic).otherwise(F.col("record"))
    return B.checked(coded.select("blk", record.alias("record"))).select("blk", "code")


@query(f"WITH {EV} SELECT blk, 'F64' AS dtype, 'VECTOR_1D' AS layout, count(*) AS elements, 8 * count(*) AS bytes FROM ev GROUP BY blk")
def decode_peek(spark, sf_dir):
    """What records hold, from their headers."""
    found = B.peeked(B.encode(events(spark, sf_dir, "value"), CodecSpec(M.DELTA_1D, (R.BYTE_SHUFFLE,), (E.LZ,))))
    return found.select("blk", "dtype", "layout", F.col("shape")[0].alias("elements"), "bytes")


@query(f"WITH {EV} SELECT blk, i, event_type AS v FROM ev WHERE event_type LIKE '%e%'")
def dict_block_filter(spark, sf_dir):
    """The dictionaries of records are filtered, and only then joined with their indices."""
    coded = B.encode(events(spark, sf_dir, "event_type"), CodecSpec(M.DICT_1D, (R.BYTE_SHUFFLE,), (E.LZ,)))
    words = B.dictionaries(coded).withColumn("v", F.col("v").cast("string")).where("v LIKE '%e%'")
    return B.dictionary_indices(coded).join(words, ["blk", "code"]).select("blk", "i", "v")


@query(_PLAIN.format("user_id"))
def rt_pushpull(spark, sf_dir):
    """Each block's bytes through a push encoder and decoder, in odd portions."""
    from blockweave.plans.samples import through_streams

    return through_streams(events(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    from blockweave.sources.table import install

    install(spark)
    path = scratch(spark)
    read(spark, sf_dir, "events").repartitionByRange(2, "event_id").sortWithinPartitions("event_id").write.format("blockstore").option("rows", ROWS).mode("append").save(path)
    return path


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def rt_container(spark, sf_dir):
    return spark.read.format("blockstore").load(_stored(spark, sf_dir))


@query("SELECT event_id, value FROM events WHERE event_id BETWEEN 3000 AND 5000")
def rowgroup_project(spark, sf_dir):
    """Two columns of the row groups that the range allows."""
    found = spark.read.format("blockstore").option("columns", "event_id,value").option("low.event_id", 3000).option("high.event_id", 5000).load(_stored(spark, sf_dir))
    return found.where("event_id BETWEEN 3000 AND 5000")


@query("SELECT event_id, value FROM events WHERE event_id > 4000 AND event_id <= 6000 AND value < 75")
def pushed_filters(spark, sf_dir):
    """Row groups by the query's own filters."""
    return spark.read.format("blockstore").load(_stored(spark, sf_dir)).where("event_id > 4000 AND event_id <= 6000 AND value < 75").select("event_id", "value")


@query(f"""WITH f AS (SELECT event_id < (SELECT count(*) FROM events) AS f, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT least({ROWS}, n - {ROWS} * g) AS rows FROM f, unnest(range((n + {ROWS} - 1) // {ROWS})) u(g))
    SELECT rows, dtype, count(*) AS blocks FROM g, (VALUES ('I64'), ('I64'), ('I64'), ('STRING'), ('F64'), ('STRING')) v(dtype) GROUP BY ALL""")
def read_in_order(spark, sf_dir):
    """Records by one pass over a container, without its index: how many of each type and size."""
    from blockweave.sources.table import install, read_sequence

    install(spark)
    path = scratch(spark)
    read(spark, sf_dir, "events").coalesce(1).write.format("blockstore").option("rows", ROWS).mode("append").save(path)
    return read_sequence(spark, path).groupBy("rows", "dtype").agg(F.count("*").alias("blocks"))


@query("SELECT event_id, user_id, value * 2 AS twice FROM events")
def widen_columns(spark, sf_dir):
    from blockweave.sources.table import widen_table

    path = _stored(spark, sf_dir)
    widen_table(spark, path, read(spark, sf_dir, "events").select("event_id", (F.col("value") * 2).alias("twice")), "event_id")
    return spark.read.format("blockstore").load(path).select("event_id", "user_id", "twice")


@query("SELECT * FROM (VALUES ('event_id', 'I64'), ('ts', 'I64'), ('user_id', 'I64'), ('event_type', 'STRING'), ('value', 'F64'), ('props', 'STRING')) v(name, dtype)")
def schema_of(spark, sf_dir):
    from blockweave.sources.table import inspect_table

    return inspect_table(spark, _stored(spark, sf_dir)).select("name", "dtype").distinct()


_CUT = 100


@query(f"""WITH {EV}, b AS (SELECT blk, count(*) AS n FROM ev GROUP BY blk) SELECT blk, p AS portion, least(n, p * 77) // {_CUT} AS blocks, least(n, p * 77) // {_CUT} * {_CUT} * 8 AS bytes FROM b, unnest(range((n + 76) // 77 + 1)) u(p)
    UNION ALL SELECT blk, -1, (n + {_CUT} - 1) // {_CUT}, n * 8 FROM b""")
def checkpoint(spark, sf_dir):
    """What a push encoder's checkpoint says after each portion of 77 elements, and (portion -1) at the end."""
    from blockweave.plans.samples import checkpoints

    return checkpoints(events(spark, sf_dir), _CUT, 77)
