"""Container tables: folders of container files, as a Spark data source and as functions.

    df.write.format("blockstore").option("rows", 1024).mode("append").save(path)
    spark.read.format("blockstore").option("columns", "a,b").option("low.a", 10).load(path)
"""

from __future__ import annotations

import base64
import contextlib
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from blockweave.errors import BlockError, ContainerIOError
from blockweave.operators.blocks import from_block, to_block
from blockweave.sources.container import Column, Reader, Stats, Writer, compute_stats, inspect, may_hold, pack_index, pack_schema, unpack_index, unpack_schema, widen
from blockweave.spec import CodecSpec
from blockweave.types import DType, Layout, dtype_of

SUFFIX, MANIFEST = ".blocks", "_manifest-"
#: Bytes of encoded blocks from which a task goes on in another container; they are held until it is written.
CONTAINER_BYTES = 128 << 20


class Folder:
    """A table's folder on any file system that Arrow opens by its URI (local, HDFS, S3, GCS and others).

    Containers are written whole, under names of their own. What belongs to the table is said by manifests, small
    files that each write leaves when all its tasks are done: containers with schema and index (so statistics are
    read without opening a container), and containers that they replace. A folder without manifests has all the
    containers that are in it.
    """

    def __init__(self, path: str):
        self.path = path
        try:
            if path.startswith("file:"):
                path = "/" + path[len("file:") :].lstrip("/")
            self.fs, self.at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
        except (pa.ArrowException, OSError) as e:
            raise ContainerIOError(f"{path}: {e}") from e

    def join(self, name: str) -> str:
        return f"{self.at.rstrip('/')}/{name}"

    def names(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.at, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def open(self, name: str):
        return self.fs.open_input_file(self.join(name))

    def put(self, name: str, data: bytes) -> None:
        """The whole file, or none: beside its place first, for a manifest counts as soon as it is there."""
        self.fs.create_dir(self.at, recursive=True)
        aside = self.join(f".{name}")
        with self.fs.open_output_stream(aside) as f:
            f.write(data)
        self.fs.move(aside, self.join(name))

    def delete(self, names: list[str]) -> None:
        for name in names:
            with contextlib.suppress(OSError):
                self.fs.delete_file(self.join(name))

    def containers(self) -> dict[str, tuple[list[Column], list]]:
        """Schema and row groups of each container of the table, by name."""
        names = self.names()
        said, gone = {}, set()
        for name in (n for n in names if n.startswith(MANIFEST)):
            with self.open(name) as f:
                m = json.loads(f.read())
            gone |= set(m["replaces"])
            said |= {x["name"]: x for x in m["containers"]}
        if said or gone:
            return {n: (unpack_schema(base64.b64decode(x["schema"])), unpack_index(base64.b64decode(x["index"]))) for n, x in sorted(said.items()) if n not in gone}
        out = {}
        for name in (n for n in names if n.endswith(SUFFIX) and not n.startswith(".")):
            with self.open(name) as f:
                r = Reader(f)
            out[name] = r.schema, r.groups
        return out

    def commit(self, containers: list[dict], replaces: list[str]) -> None:
        self.put(f"{MANIFEST}{uuid.uuid4().hex}", json.dumps({"containers": containers, "replaces": replaces}).encode())

    def add(self, data: bytes) -> dict:
        """Writes a container; its entry for a manifest."""
        name = f"{uuid.uuid4().hex}{SUFFIX}"
        r = Reader(io.BytesIO(data))
        self.put(name, data)
        return {"name": name, "schema": base64.b64encode(pack_schema(r.schema)).decode(), "index": base64.b64encode(pack_index(r.groups)).decode()}


def schema_of(path: str) -> T.StructType:
    """Spark types, with element type and annotation as metadata."""
    found = Folder(path).containers()
    if not found:
        raise ContainerIOError(f"{path}: no containers")
    columns = next(iter(found.values()))[0]
    fields = []
    for c in columns:
        note = json.loads(c.annotation) if c.annotation.startswith("{") else {"annotation": c.annotation}
        kind = T.StringType() if note.get("spark") == "string" else T.TimestampNTZType() if note.get("spark") == "timestamp_ntz" else c.dtype.spark
        fields.append(T.StructField(c.name, kind, True, {"dtype": c.dtype.name, **({"unsigned_bits": c.dtype.size * 8} if c.dtype.name[0] == "U" else {}), "annotation": note.get("annotation", "")}))
    return T.StructType(fields)


@dataclass
class _Group(InputPartition):
    file: str
    group: int


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.schema = options["path"], schema
        self.ranges: dict[str, list] = {}
        for k, v in options.items():
            side, _, name = k.partition(".")
            if side in ("low", "high"):
                self.ranges.setdefault(name.lower(), [None, None])[side == "high"] = v

    def partitions(self) -> list[_Group]:
        """Row groups whose statistics allow the ranges."""
        out = []
        for name, (schema, groups) in Folder(self.path).containers().items():
            names = [c.name.lower() for c in schema]
            for g, group in enumerate(groups):
                ok = True
                for column, (low, high) in self.ranges.items():
                    if column in names:
                        i = names.index(column)
                        kind = schema[i].dtype
                        cast = (lambda x: x) if kind.is_variable else float if kind.is_float else int
                        stats = group.stats[i] if group.stats else Stats(known=False)
                        ok &= may_hold(stats, kind, *(None if x is None else cast(x) for x in (low, high)))
                if ok:
                    out.append(_Group(name, g))
        return out or [_Group("", -1)]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        if partition.group < 0:
            return
        with Folder(self.path).open(partition.file) as f:
            r = Reader(f)
            names = [c.name for c in r.schema]
            arrays = []
            for field in self.schema.fields:
                x = from_block(r.block(partition.group, names.index(field.name)))
                if isinstance(field.dataType, T.StringType):
                    x = x.cast(pa.string())
                elif isinstance(field.dataType, T.TimestampNTZType):
                    x = x.cast(pa.timestamp("us"))
                arrays.append(x)
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema.fields])


class _PushdownReader(_Reader):
    def pushFilters(self, filters):
        """Comparisons with constants narrow the ranges; Spark checks every row again."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                held = self.ranges.setdefault(f.attribute[0].lower(), [None, None])
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    held[0] = f.value
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    held[1] = f.value
            yield f


@dataclass
class _Done(WriterCommitMessage):
    containers: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite
        self.rows, self.most = int(options.get("rows", 65536)), int(options.get("bytes", CONTAINER_BYTES))
        chosen = json.loads(options.get("spec", "{}"))
        self.specs = {c: CodecSpec(s.get("model", 1), tuple(s.get("transforms", ())), tuple(s.get("entropies", ())), s.get("model_params", {})) for c, s in chosen.items()}

    def _columns(self) -> list[Column]:
        out = []
        for f in self.schema.fields:
            note = {"annotation": (f.metadata or {}).get("annotation", "")}
            if isinstance(f.dataType, (T.StringType, T.TimestampNTZType, T.TimestampType)):
                note["spark"] = "string" if isinstance(f.dataType, T.StringType) else "timestamp_ntz"
            out.append(Column(f.name, dtype_of(f), json.dumps(note)))
        return out

    def spec(self, dtype: DType, name: str) -> CodecSpec:
        """The caller's, or one by type: dictionary, or delta, bit planes and LZ."""
        return self.specs.get(name) or (CodecSpec(3, (3,), (1,)) if dtype.is_variable else CodecSpec(2, (4,), (1,)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        """Containers of a task's rows; a task without rows writes none. What attempts that fail leave, no manifest
        names."""
        folder, columns, done, held, n = Folder(self.path), self._columns(), [], [], 0
        file, writer = None, None

        def group(table: pa.Table) -> None:
            nonlocal file, writer
            if writer is None:
                file = io.BytesIO()
                writer = Writer(file, columns)
            blocks = [to_block(table.column(c.name), c.dtype, Layout.VECTOR_1D, (table.num_rows,)) for c in columns]
            for c, b in zip(columns, blocks, strict=True):
                writer.write_block(b, self.spec(c.dtype, c.name))
            writer.set_stats([compute_stats(b) for b in blocks])
            writer.end_group(table.num_rows)
            if file.tell() >= self.most:
                closed()

        def closed() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                done.append(folder.add(file.getvalue()))
                writer = None

        for batch in iterator:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            while n >= self.rows:
                table = pa.Table.from_batches(held)
                group(table.slice(0, self.rows))
                rest = table.slice(self.rows)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            group(pa.Table.from_batches(held))
        closed()
        return _Done(done)

    def commit(self, messages: list[_Done | None]) -> None:
        """One manifest: all of a write is there, and what it replaces is not, from one moment on."""
        folder = Folder(self.path)
        old = list(folder.containers()) if self.overwrite else []
        folder.commit([c for m in messages if m for c in m.containers], old)
        folder.delete(old)

    def abort(self, messages: list[_Done | None]) -> None:
        Folder(self.path).delete([c["name"] for m in messages if m for c in m.containers])


class BlockStore(DataSource):
    """Options: path; columns (comma-separated); low.NAME and high.NAME; for writes rows (a row group), bytes (a
    container) and spec (JSON: column -> model, transforms, entropies). Spark's filters narrow the row groups."""

    @classmethod
    def name(cls) -> str:
        return "blockstore"

    def schema(self) -> T.StructType:
        found, wanted = schema_of(self.options["path"]), self.options.get("columns")
        return T.StructType([found[c.strip()] for c in wanted.split(",")]) if wanted else found

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PushdownReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


class PlainBlockStore(BlockStore):
    """As BlockStore, for sessions that don't allow filters to reach Python sources: ranges by options only."""

    @classmethod
    def name(cls) -> str:
        return "blockstore_plain"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def install(spark: SparkSession) -> None:
    """Registers the sources, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BlockStore, PlainBlockStore):
        spark.dataSource.register(source)


_BLOCKS = "file string, group long, column int, name string, dtype string, layout string, shape array<long>, model int, transforms array<int>, entropies array<int>, offset long, bytes long, uncompressed long, low string, high string, nulls long"


def inspect_table(spark: SparkSession, path: str) -> DataFrame:
    """One row a block of every container."""
    names = list(Folder(path).containers())
    files = spark.createDataFrame([(f,) for f in names], "file string")

    def run(batches):
        arrow = pa.schema([("file", pa.string()), ("group", pa.int64()), ("column", pa.int32()), ("name", pa.string()), ("dtype", pa.string()), ("layout", pa.string()), ("shape", pa.list_(pa.int64())), ("model", pa.int32()), ("transforms", pa.list_(pa.int32())), ("entropies", pa.list_(pa.int32())), ("offset", pa.int64()), ("bytes", pa.int64()), ("uncompressed", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("nulls", pa.int64())])
        for batch in batches:
            rows = []
            for name in batch.column("file").to_pylist():
                with Folder(path).open(name) as f:
                    rows += [{"file": name} | r for r in inspect(f)]
            yield from pa.Table.from_pylist(rows, arrow).to_batches()

    return files.repartition(max(1, len(names))).mapInArrow(run, _BLOCKS)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The block records of every container in file order, without its index: file, n (of the record), dtype, rows,
    bytes and record. Widened containers have random access only and are an error."""
    names = list(Folder(path).containers())
    files = spark.createDataFrame([(f,) for f in names], "file string")

    def run(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with Folder(path).open(name) as f:
                    reader = Reader(f)
                    at = reader.blocks_at
                    for n, r in enumerate(reader.blocks()):
                        data = reader._read(at, r.size)
                        at += r.size
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([r.dtype.name]), pa.array([r.shape[0]], pa.int64()), pa.array([r.size], pa.int64()), pa.array([data], pa.binary())], ["file", "n", "dtype", "rows", "bytes", "record"])

    return files.repartition(max(1, len(names))).mapInArrow(run, "file string, n long, dtype string, rows long, bytes long, record binary")


def widen_table(spark: SparkSession, path: str, rows: DataFrame, key: str, spec: CodecSpec | None = None) -> int:
    """Appends the columns of `rows` (all but `key`) to every container of a table, matched by the values of the
    table's `key` column, which must be unique there and complete in `rows`; returns the containers widened.

    Each container, whose size is bounded, is widened by one task into a new one; a manifest puts all new ones in
    the place of the old ones at once. A task that is run again writes another file that nothing names."""
    folder = Folder(path)
    names = list(folder.containers())
    where = spark.createDataFrame([(i, f) for i, f in enumerate(names)], "id int, file string")
    new = [f for f in rows.schema.fields if f.name != key]

    def keys(batches):
        for batch in batches:
            for i, name in zip(batch.column("id").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with Folder(path).open(name) as f:
                    r = Reader(f)
                    at = [c.name for c in r.schema].index(key)
                    for g in range(len(r.groups)):
                        k = from_block(r.block(g, at)).cast(pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(k), pa.int32()), pa.array([g] * len(k)), pa.array(range(len(k))), k], ["id", "g", "i", "k"])

    placed = where.repartition(max(1, len(names))).mapInArrow(keys, "id int, g long, i long, k long").join(rows.withColumnRenamed(key, "k"), "k")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("i", "ascending")])
        with Folder(path).open(names[table.column("id")[0].as_py()]) as f:
            file = io.BytesIO(f.read())
        old = Reader(file)
        sizes, at, groups = [g.rows for g in old.groups], 0, []
        if table.num_rows != sum(sizes):
            raise BlockError("a value for every row is needed")
        for n in sizes:
            part = table.slice(at, n)
            groups.append([(to_block(part.column(c.name), dtype_of(c), Layout.VECTOR_1D, (n,)), spec) for c in new])
            at += n
        notes = {"string": T.StringType, "timestamp_ntz": T.TimestampNTZType}
        columns = [Column(c.name, dtype_of(c), json.dumps({"annotation": (c.metadata or {}).get("annotation", "")} | {"spark": k for k, t in notes.items() if isinstance(c.dataType, t)})) for c in new]
        widen(file, columns, groups)
        return pa.table({"entry": pa.array([json.dumps(Folder(path).add(file.getvalue()))])})

    done = [json.loads(r["entry"]) for r in placed.groupBy("id").applyInArrow(run, "entry string").collect()]
    if len(done) != len(names):
        raise BlockError("a value for every row is needed")
    folder.commit(done, names)
    folder.delete(names)
    return len(done)
