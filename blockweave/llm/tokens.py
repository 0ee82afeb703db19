"""Tokenising with the public byte-level BPE, and delta-maintained token rollups (operator 3)."""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import released, shared_dir, sliced

VOCABULARY = "byte_bpe_50k"
#: Beyond these characters the two libraries' Unicode tables may differ, so the text goes to the slower one.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧₠-₿]*", re.ASCII)


@lru_cache(4)
def encoder(vocabulary: str = VOCABULARY, special: bool = True):
    """A function text -> uint32 ids, equal to `tokenizers` with add_special_tokens=False.

    The same vocabulary's ranks in tiktoken are several times faster; texts with characters outside the
    plain range, or with the special token's own string, take the `tokenizers` path. special=False: never
    reads that string as the special token.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb")
    with lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made: list[Tokenizer] = []

    def slow() -> Tokenizer:
        """Made when a text first needs it."""
        if not made:
            made.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            made[0].encode_special_tokens = not special
        return made[0]

    def ids(text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return np.asarray(fast.encode_to_numpy(text), "<u4")
        return np.array(slow().encode(text, add_special_tokens=False).ids, "<u4")

    return ids


def cut(ids: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) pieces of at most `limit`; only the first may be shorter."""
    head = len(ids) % limit or limit
    edges = [0, *range(head, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
    return [(a, ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def token_pieces(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's ids followed by `end_id`; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4")
                out += [(doc, i, start, len(part), zlib.crc32(part.tobytes())) for i, (start, part) in enumerate(cut(ids, limit))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, n_tokens of every whole text (null text: 0 tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in sliced(batches):
            n = [len(ids_of(x)) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(released(run), "doc_id long, source string, lang string, n_tokens long")


class Rollup:
    """Additive totals by source, language and tokenizer version, kept as signed deltas.

    A batch is a table of signed changes: sign +1 inserts a document's count, -1 deletes it, and a revision
    is a pair of both. Each batch is pre-aggregated to one row a key, written, and then committed under its own
    id by an entry in the log: a small file of a name that no other writer uses, renamed into place whole. The
    log alone says what counts:

    - of several entries of one batch, from writers that raced, the first by name counts;
    - a fold says which entries its table stands for; where folds overlap, the one that stands for more counts,
      and then the first by name, and what only the other one stood for counts by itself.

    So every reader of one log comes to the same tables, each batch counts once, and a job that is cut short
    between any two steps leaves either no entry or a whole one, besides files that nothing refers to. Replays
    of a batch change nothing, also after folding. compact() folds all that counts; vacuum() deletes what no
    longer does, and is the only step that deletes tables. Null sources and languages are keys of their own;
    an empty batch commits and changes nothing; keys whose documents and tokens cancel out vanish.
    """

    KEYS = ("source", "lang", "tokenizer")
    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/log"))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _log(self) -> dict[str, dict]:
        """Entries by name: batch and data, or the batches and entries that a fold stands for and data."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/log"))]
        out = {}
        for name in sorted(n for n in names if n.startswith("entry-")):
            stream = self._fs.open(self._at(f"{self.path}/log/{name}"))
            try:
                out[name] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return out

    @staticmethod
    def _counting(log: dict[str, dict]) -> tuple[dict[str, dict], dict[str, str]]:
        """Of the entries those that count, and of each batch the entry that stands for it."""
        live, of_batch = {}, {}
        folds = sorted((n for n in log if "folds" in log[n]), key=lambda n: (-len(log[n]["folds"]), n))
        for name in folds:
            if not log[name]["folds"].keys() & of_batch.keys():
                live[name] = log[name]
                of_batch |= log[name]["folds"]
        for name in sorted(n for n in log if "batch" in log[n]):
            if log[name]["batch"] not in of_batch:
                live[name], of_batch[log[name]["batch"]] = log[name], name
        return live, of_batch

    def batches(self) -> list[str]:
        """Ids of all committed batches, folded or not."""
        return sorted(self._counting(self._log())[1])

    def committed(self, batch: str) -> bool:
        return batch in self._counting(self._log())[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: source, lang, tokenizer, n_tokens and sign. False: the batch was there already."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*self.KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        name = self._put(sums, {"batch": batch})
        return self._counting(self._log())[1].get(batch) == name

    def _put(self, sums: DataFrame, entry: dict) -> str:
        """Table, then entry beside its place, then the rename that makes it count."""
        own = uuid.uuid4().hex
        self._step("table")
        # A row a key: much less than what is aggregated, so a file for 16 of its partitions.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sums.coalesce(max(8, parts // 16)).write.parquet(f"{self.path}/data-{own}")
        self._step("entry")
        stream = self._fs.create(self._at(f"{self.path}/log/aside-{own}"), False)
        stream.write(json.dumps(entry | {"data": f"data-{own}"}).encode())
        stream.close()
        self._step("rename")
        if not self._fs.rename(self._at(f"{self.path}/log/aside-{own}"), self._at(f"{self.path}/log/entry-{own}")):
            raise OSError(f"{self.path}/log/entry-{own}")
        self._step("done")
        return f"entry-{own}"

    def _step(self, name: str) -> None:
        """Before each step that others can see; tests stop here."""

    def _sums(self, live: dict[str, dict]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{e['data']}" for e in live.values()])
        sums = rows.groupBy(*self.KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._counting(self._log())[0])

    def compact(self) -> None:
        """Folds all that counts into one table; the batches' ids stay known, so replays stay no-ops."""
        live, of_batch = self._counting(self._log())
        if len(live) > 1:
            self._put(self._sums(live), {"folds": of_batch})

    def vacuum(self) -> None:
        """Deletes entries that no longer count, and their tables, entries first. Not while others still read."""
        log = self._log()
        live, _ = self._counting(log)
        # A fold that counts must go on counting: what it stands for goes before smaller folds do.
        for name in sorted(log.keys() - live.keys(), key=lambda n: len(log[n].get("folds", ()))):
            self._step("delete entry")
            self._fs.delete(self._at(f"{self.path}/log/{name}"), False)
            self._step("delete table")
            self._fs.delete(self._at(f"{self.path}/{log[name]['data']}"), True)


def new_rollup(spark: SparkSession) -> Rollup:
    return Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
