"""Language identification by a byte convolutional network (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import released, sliced

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: Labelled texts that training reads at most, and windows that they have in all, dealt evenly to the languages and
#: chosen by a hash of doc_id. A text is read whole or not at all.
SAMPLE, SAMPLE_WINDOWS = 6000, 24_000
#: Passes over the sample, and training steps at least.
EPOCHS, STEPS = 2, 600
BATCH, RATE, SEED = 64, 3e-3, 20240607
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
Model = dict[str, np.ndarray]


def windows(data: bytes, width: int = WINDOW) -> np.ndarray:
    """All of a text as rows of `width` bytes, the last filled with spaces; at least one row."""
    x = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(x) // width))
    out = np.full(n * width, 32, np.uint8)
    out[: len(x)] = _FOLD[x]
    return out.reshape(n, width)


def has_letter(text: str) -> bool:
    """Whether a character is a letter to Unicode; other signs of number that the pattern takes are not."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _forward(m: Model, x: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    e, kept, pooled = m["embed"][x], [], []
    for w in WIDTHS:
        wide = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
        act = wide @ m[f"w{w}"]
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None], 1)[:, 0] + m[f"b{w}"]
        kept.append((wide, at, top))
        pooled.append(np.maximum(top, 0))
    hidden = np.concatenate(pooled, axis=1)
    z = hidden @ m["out"] + m["bias"]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return kept, hidden, p / p.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = EPOCHS) -> Model:
    """Multi-width filters over byte embeddings, max pooling and softmax, by Adam on cross entropy."""
    rng = np.random.default_rng(SEED)
    m: Model = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
    for w in WIDTHS:
        m |= {f"w{w}": rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    first, second, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            kept, hidden, p = _forward(m, xb)
            g = {k: np.zeros_like(v) for k, v in m.items()}
            p[np.arange(len(xb)), yb] -= 1
            p /= len(xb)
            g["out"], g["bias"] = hidden.T @ p, p.sum(axis=0)
            back, rows = p @ m["out"].T, np.arange(len(xb))
            for i, w in enumerate(WIDTHS):
                wide, place, top = kept[i]
                d = back[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
                g[f"b{w}"] = d.sum(axis=0)
                met = wide[rows[:, None], place]
                g[f"w{w}"] = np.einsum("bfk,bf->kf", met, d, optimize=True)
                into = np.einsum("bf,kf->bfk", d, m[f"w{w}"]).reshape(len(xb), FILTERS, w, EMBEDDING)
                for j in range(w):
                    np.add.at(g["embed"], xb[rows[:, None], place + j], into[:, :, j])
            t += 1
            for k in m:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                m[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m


class Tables:
    """The trained network with its first two layers folded into sums of byte and byte-pair tables."""

    def __init__(self, m: Model):
        own = {w: [m["embed"] @ m[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)] for w in WIDTHS}
        self.parts = {w: [(j, 2, (t[j][:, None] + t[j + 1][None]).reshape(-1, FILTERS)) if j + 1 < w else (j, 1, t[j]) for j in range(0, w, 2)] for w, t in own.items()}
        self.m = m

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each window."""
        out = []
        for at in range(0, len(x), 128):
            part = x[at : at + 128]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w, parts in self.parts.items():
                n = part.shape[1] - w + 1
                act = sum(t[pair[:, j : j + n] if size == 2 else part[:, j : j + n]] for j, size, t in parts)
                pooled.append(np.maximum(act.max(axis=1) + self.m[f"b{w}"], 0))
            z = np.concatenate(pooled, axis=1) @ self.m["out"] + self.m["bias"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def fit(labelled: DataFrame, sample: int = SAMPLE, sample_windows: int = SAMPLE_WINDOWS) -> tuple[list[str], Model | None]:
    """Languages and network learned from at most `sample` rows of doc_id, text, lang (all of them usable), which
    have at most `sample_windows` windows but for the first row of a language. All windows of a chosen row are
    read. Every language that a row has is learned; rows without a letter teach nothing."""
    spark = labelled.sparkSession
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}
    langs = list(counts)
    if not langs:
        return [], None
    each, space = max(1, sample // len(langs)), max(1, sample_windows // len(langs))
    # A threshold on the hash leaves a few times the rows that are wanted before they are ranked, so that a
    # frequent language doesn't gather in one task.
    share = spark.createDataFrame([(k, min(1 << 20, int(4 * each * (1 << 20) / n) + 1)) for k, n in counts.items()], "lang string, below long")
    some = labelled.selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h", f"greatest(1, ceil(octet_length(text) / {WINDOW})) AS w").join(F.broadcast(share), "lang").where(f"pmod(h, {1 << 20}) < below")
    # Texts that would fill a quarter of the space come last.
    ranked = some.dropDuplicates(["doc_id"]).withColumn("large", F.col("w") > space / 4)
    order = "PARTITION BY lang ORDER BY large, h, doc_id"
    chosen = ranked.selectExpr("doc_id", f"row_number() OVER ({order}) AS r", f"sum(w) OVER ({order} ROWS UNBOUNDED PRECEDING) AS total").where(f"r = 1 OR r <= {each} AND total <= {space}").select("doc_id")
    rows = [r for r in labelled.join(F.broadcast(chosen), "doc_id").select("lang", "doc_id", "text").dropDuplicates(["doc_id"]).orderBy("doc_id").collect() if has_letter(r["text"])]
    if not rows:
        return [], None
    cut = [windows(r["text"].encode()) for r in rows]
    x = np.concatenate(cut)
    y = np.repeat([langs.index(r["lang"]) for r in rows], [len(c) for c in cut])
    return langs, train(x, y, len(langs), max(EPOCHS, -(-STEPS * BATCH // len(x))))


def identify(docs: DataFrame, langs: list[str], model: Model | None, batch: int = 1 << 13) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    A text is all its windows; its probabilities are their mean, and score is the highest. Texts that are
    null or have no letter, and all texts if nothing was learned, are `und` with score 0. Rows that repeat a
    doc_id, or have none, each get their row.
    """
    tables = docs.sparkSession.sparkContext.broadcast((langs, Tables(model) if model else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, net = tables.value
        for rows in sliced(batches):
            pred, score = [], []
            held: list[np.ndarray] = []

            def settle() -> None:
                if held:
                    p = net.probabilities(np.concatenate(held))
                    begin = np.concatenate(([0], np.cumsum([len(x) for x in held])[:-1]))
                    mean = np.add.reduceat(p, begin, axis=0) / np.array([[len(x)] for x in held])
                    pred.extend(names[i] for i in mean.argmax(axis=1))
                    score.extend(np.clip(mean.max(axis=1), 0, 1).astype(float))
                    held.clear()

            n = 0
            for text in rows.column("text").to_pylist():
                if net is None or not text or not has_letter(text):
                    settle()
                    pred.append("und")
                    score.append(0.0)
                else:
                    held.append(windows(text.encode()))
                    n += len(held[-1])
                if n > batch:
                    settle()
                    n = 0
            settle()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, lang_pred string, score double")
