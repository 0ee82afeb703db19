"""Models, transforms and statistics on long-form DataFrames, as expressions, windows and aggregates.

Rows are (blk, i, v), (blk, y, x, v) or (blk, z, y, x, v): blk names the block, the others the place in it.
Windows never span blocks, so every operator is partitioned by blk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockweave.functions import expr as X
from blockweave.shared import kept

AUTO_SAMPLE = 10_000


def dense_blocks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """blk and i from a unique integer key: no shuffle."""
    return df.withColumns({"blk": F.floor(F.col(key) / rows).cast("bigint"), "i": F.pmod(F.col(key), F.lit(rows)).cast("bigint")})


def numbered(df: DataFrame, order: list[str], rows: int, partitions: int | None = None) -> DataFrame:
    """blk and i by position in a total order, without a single-partition sort: rows are dealt out by range (into
    `partitions`, or as many as shuffles have), written once in the shared folder with their number in their
    range, and moved on by the sizes of the ranges before, one number a range."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    local = kept(dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1), "ranges")
    sizes = local.groupBy("_p").count()
    base = sizes.withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = (F.col("_r") + F.col("_b")).cast("bigint")
    joined = local.join(F.broadcast(base.select("_p", "_b")), "_p")  # one row a range: `partitions` rows at most
    return joined.withColumns({"blk": F.floor(at / rows).cast("bigint"), "i": F.pmod(at, F.lit(rows))}).drop("_p", "_r", "_b")


def _along(*order: str, part: tuple[str, ...] = ("blk",)):
    return Window.partitionBy(*part).orderBy(*order)


def delta(df: DataFrame, bits: int = 64, value: str = "v") -> DataFrame:
    """r: v minus the one before, modulo 2**bits."""
    before = F.coalesce(F.lag(value).over(_along("i")), F.lit(0))
    return df.withColumn("r", X.minus(F.col(value), before, bits))


def undelta(df: DataFrame) -> DataFrame:
    """v from r: a running sum modulo 2**64."""
    w = _along("i").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("v", X.wrapped_sum(F.sum(F.col("r").cast("decimal(28,0)")).over(w)))


def xor_delta(df: DataFrame, value: str = "bits") -> DataFrame:
    """r: bits XOR those before."""
    before = F.coalesce(F.lag(value).over(_along("i")), F.lit(0).cast("bigint"))
    return df.withColumn("r", F.col(value).bitwiseXOR(before))


def undo_xor_delta(df: DataFrame) -> DataFrame:
    w = _along("i").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bits", F.bit_xor("r").over(w))


def dictionary(df: DataFrame, value: str = "v") -> DataFrame:
    """blk, code, v: the distinct values of each block, numbered by first occurrence."""
    first = df.groupBy("blk", value).agg(F.min("i").alias("first"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy("blk").orderBy("first")) - 1).select("blk", "code", value)


def dictionary_codes(df: DataFrame, value: str = "v") -> DataFrame:
    """blk, i, code. Nulls are a value of their own."""
    words = dictionary(df, value).withColumnRenamed(value, "_w").withColumnRenamed("blk", "_b")
    return df.join(words, (F.col("blk") == F.col("_b")) & F.col(value).eqNullSafe(F.col("_w"))).select("blk", "i", "code")


def from_dictionary(codes: DataFrame, words: DataFrame) -> DataFrame:
    """blk, i, v. A filter on `words` before this decodes only what it keeps."""
    return codes.join(words, ["blk", "code"]).drop("code")


def sparse_entries(df: DataFrame, value: str = "v") -> DataFrame:
    """blk, i, v of the elements that are not zero."""
    return df.where(F.col(value) != 0).select("blk", "i", value)


def from_sparse(entries: DataFrame, sizes: DataFrame, value: str = "v") -> DataFrame:
    """All places of blocks of the given sizes (blk, n), zeros where no entry is."""
    places = sizes.where("n > 0").select("blk", F.explode(F.expr("sequence(0L, CAST(n AS BIGINT) - 1)")).alias("i"))
    return places.join(entries, ["blk", "i"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def runs(df: DataFrame, value: str = "v") -> DataFrame:
    """blk, run, first, n, v: maximal runs of equal values."""
    w = _along("i")
    flag = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_f", flag).withColumn("run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy("blk", "run").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.min(value).alias(value))


def from_runs(found: DataFrame, value: str = "v") -> DataFrame:
    return found.select("blk", F.explode(F.expr("sequence(CAST(first AS BIGINT), CAST(first AS BIGINT) + n - 1)")).alias("i"), value)


def _causal2d(df: DataFrame, part: tuple[str, ...] = ("blk",), value: str = "v") -> tuple[DataFrame, Column, Column, Column]:
    zero = F.lit(0)
    df = df.withColumn("_left", F.coalesce(F.lag(value).over(_along("x", part=(*part, "y"))), zero))
    up = _along("y", part=(*part, "x"))
    df = df.withColumns({"_up": F.coalesce(F.lag(value).over(up), zero), "_corner": F.coalesce(F.lag("_left").over(up), zero)})
    return df, F.col("_left"), F.col("_up"), F.col("_corner")


PREDICTORS_2D = {
    "left": lambda a, b, c: a,
    "up": lambda a, b, c: b,
    "average": lambda a, b, c: X.truncated_half(a + b),
    "paeth": lambda a, b, c: X.paeth(a, b, c, a + b - c),
}


def predict2d(df: DataFrame, kind: str, part: tuple[str, ...] = ("blk",), value: str = "v", bits: int = 32) -> DataFrame:
    """r: v minus its prediction from the left, upper and corner neighbours; 0 outside."""
    df, *near = _causal2d(df, part, value)
    return df.withColumn("r", X.minus(F.col(value), PREDICTORS_2D[kind](*near), bits)).drop("_left", "_up", "_corner")


def unpredict2d(df: DataFrame, kind: str) -> DataFrame:
    """v from r for left and up: a running sum a row or a column."""
    part, order = (("blk", "y"), "x") if kind == "left" else (("blk", "x"), "y")
    w = _along(order, part=part).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("v", X.wrap(F.sum(F.col("r").cast("bigint")).over(w), 32))


def choose2d(df: DataFrame, width: int, bits: int = 32) -> DataFrame:
    """blk, kind: the predictor with the least sum of residuals over the first rows, all in one pass."""
    some, *near = _causal2d(df.where(F.col("y") < max(1, AUTO_SAMPLE // width)))
    costs = [F.sum(F.abs(X.minus(F.col("v"), p(*near), bits))).alias(k) for k, p in PREDICTORS_2D.items()]
    least = F.least(*PREDICTORS_2D)
    kind = F.coalesce(*[F.when(F.col(k) == least, F.lit(k)) for k in PREDICTORS_2D])
    return some.groupBy("blk").agg(*costs).select("blk", kind.alias("kind"), *PREDICTORS_2D)


def interslice(df: DataFrame, bits: int = 32) -> DataFrame:
    """r: v minus the same place of the slice before."""
    before = F.coalesce(F.lag("v").over(_along("z", part=("blk", "y", "x"))), F.lit(0))
    return df.withColumn("r", X.minus(F.col("v"), before, bits))


def _causal3d(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    zero = F.lit(0)
    steps = [("a", "v", "x", ("blk", "z", "y")), ("b", "v", "y", ("blk", "z", "x")), ("ab", "_a", "y", ("blk", "z", "x"))]
    steps += [("c", "v", "z", ("blk", "y", "x")), ("ac", "_a", "z", ("blk", "y", "x")), ("bc", "_b", "z", ("blk", "y", "x")), ("abc", "_ab", "z", ("blk", "y", "x"))]
    for name, of, order, part in steps:
        df = df.withColumn(f"_{name}", F.coalesce(F.lag(of).over(_along(order, part=part)), zero))
    return df, {name: F.col(f"_{name}") for name, *_ in steps}


def _predict3d(kind: str, n: dict[str, Column]) -> Column:
    a, b, c = n["a"], n["b"], n["c"]
    inside = [F.col(k) > 0 for k in ("x", "y", "z")]
    count = sum((k.cast("int") for k in inside), F.lit(0))
    grad = a + b + c - n["ab"] - n["ac"] - n["bc"] + n["abc"]
    if kind in ("left", "up", "front"):
        return {"left": a, "up": b, "front": c}[kind]
    if kind == "grad3d":
        return grad
    if kind == "avg3":
        return F.when(count == 3, F.expr("(_a + _b + _c) div 3")).when(count == 2, X.truncated_half(a + b + c)).otherwise(a + b + c)
    faces = F.when(~inside[2], X.paeth(a, b, n["ab"], a + b - n["ab"])).when(~inside[1], X.paeth(a, c, n["ac"], a + c - n["ac"])).otherwise(X.paeth(b, c, n["bc"], b + c - n["bc"]))
    return F.when(count == 3, X.paeth(a, b, c, grad)).when(count == 2, faces).otherwise(a + b + c)


def predict3d(df: DataFrame, kind: str, bits: int = 32) -> DataFrame:
    """r: v minus its prediction from the seven causal neighbours."""
    df, near = _causal3d(df)
    return df.withColumn("r", X.minus(F.col("v"), _predict3d(kind, near), bits)).drop(*[f"_{k}" for k in near])


def ungrad3d(df: DataFrame) -> DataFrame:
    """v from the residual of grad3d: running sums along the three axes in turn."""
    out = df.withColumn("v", F.col("r").cast("bigint"))
    for order, part in (("x", ("blk", "z", "y")), ("y", ("blk", "z", "x")), ("z", ("blk", "y", "x"))):
        out = out.withColumn("v", F.sum("v").over(_along(order, part=part).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("v", X.wrap(F.col("v"), 32))


def plane_coefficients(df: DataFrame, tile: int = 32) -> DataFrame:
    """blk, ty, tx, a, b, c: least-squares plane of each tile of a full raster in units of 1/256, from exact integer
    sums: a slope is the sum of values times their distance from the middle, by that of the squared distances."""
    tiled = df.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile), "_y": F.pmod("y", F.lit(tile)).cast("bigint"), "_x": F.pmod("x", F.lit(tile)).cast("bigint"), "_v": F.col("v").cast("bigint")})
    sums = {"n": F.count("*"), "w": F.max("_x") + 1, "h": F.max("_y") + 1, "sv": F.sum("_v"), "sx": F.sum(F.expr("_v * _x")), "sy": F.sum(F.expr("_v * _y"))}
    m = tiled.groupBy("blk", "ty", "tx").agg(*[e.cast("double").alias(k) for k, e in sums.items()])
    for name, extent, moment in (("b", "w", "sx"), ("c", "h", "sy")):
        slope = F.expr(f"({moment} - sv * (({extent} - 1) / 2)) / (n * ({extent} * {extent} - 1) / 12)")
        m = m.withColumn(name, F.when(F.col(extent) > 1, slope).otherwise(F.lit(0.0)))
    m = m.withColumn("a", F.expr("sv / n - b * ((w - 1) / 2) - c * ((h - 1) / 2)"))
    return m.select("blk", "ty", "tx", *[(F.signum(k) * F.floor(F.abs(k) * 256 + 0.5)).cast("bigint").alias(k) for k in "abc"])


def plane_residual(df: DataFrame, tile: int = 32, bits: int = 32) -> DataFrame:
    """blk, y, x, r: v minus the plane of its tile, rounded half away from zero."""
    cells = df.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    s = F.expr(f"a + b * pmod(x, {tile}) + c * pmod(y, {tile})")
    p = F.when(s < 0, -F.shiftright(-s + 128, 8)).otherwise(F.shiftright(s + 128, 8))
    return cells.join(plane_coefficients(df, tile), ["blk", "ty", "tx"]).select("blk", "y", "x", X.minus(F.col("v"), p, bits).alias("r"))


def byte_histogram(df: DataFrame, lanes: int = 8, value: str = "v") -> DataFrame:
    """lane, byte, n over the little-endian bytes of the values."""
    return df.select(F.col(value).cast("bigint").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")).select("lane", X.byte_of(F.col("v"), F.col("lane")).alias("byte")).groupBy("lane", "byte").agg(F.count("*").alias("n"))


def lane_choices(df: DataFrame, lanes: int = 8, value: str = "v") -> DataFrame:
    """lane, entropy (bits a byte) and the coder that it selects."""
    h = byte_histogram(df, lanes, value)
    p = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lane")))
    e = p.groupBy("lane").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    coder = F.when(F.col("entropy") > 7.5, "none").when(F.col("entropy") < 4.0, "huffman").otherwise("fse")
    return e.select("lane", F.round("entropy", 6).alias("entropy"), coder.alias("coder"))


def zone_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """blk, rows, and for each column its smallest and largest value and its nulls."""
    aggs = [a for c in columns for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))]
    return df.groupBy("blk").agg(F.count("*").alias("rows"), *aggs)


def prune(zones: DataFrame, column: str, low, high) -> DataFrame:
    """The blocks that may hold a value between low and high."""
    return zones.where((F.col(f"{column}_max") >= F.lit(low)) & (F.col(f"{column}_min") <= F.lit(high)))


def advice(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct and zero shares, and what they speak for: a dictionary below 5 % distinct values (no
    gain from 10 %), sparse entries from 75 % zeros."""
    aggs = [a for i, c in enumerate(columns) for a in (F.count_distinct(c).alias(f"d{i}"), F.count_if(F.col(c) == 0).alias(f"z{i}"))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"d{i}") / F.col("n")).alias("distinct_share"), (F.col(f"z{i}") / F.col("n")).alias("zero_share")) for i, c in enumerate(columns)])
    out = one.select(F.inline(rows))
    model = F.when(F.col("zero_share") >= 0.75, "sparse_zero").when(F.col("distinct_share") < 0.05, "dict_numeric").when(F.col("distinct_share") < 0.1, "dict_numeric or raw").otherwise("raw")
    return out.select("column", F.round("distinct_share", 6).alias("distinct_share"), F.round("zero_share", 6).alias("zero_share"), model.alias("model"))
