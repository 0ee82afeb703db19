"""License scan by sparse TF-IDF cosine to templates, and inheritance by directory (operator 6). DataFrame
operations only."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import written

#: Header templates by licence id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD style license, redistribution in source and binary forms is permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved. Confidential and proprietary.",
}
THRESHOLD = 0.5
#: Headers that are a small part of a template, whose other words are rarer the larger the table: its cosine with
#: them falls below any threshold. Looked for where no template is found, with words that weigh alike.
SHORT = {"Proprietary": "All rights reserved."}
#: Whole texts of licences by id, and the cosine from which a file is one of them. There is none of the two CC
#: licences, and Proprietary has none.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))}
FULL = 0.8
#: Lines that a wrapped header may take.
WRAPPED = 4
_SPLIT = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def weights(df: dict[str, int], n: int) -> tuple[dict[str, float], float]:
    """idf of each template term, and the weight of a term that no template has: that of one never met."""
    return {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}, math.log(n + 1) + 1


def anchors(templates: dict[str, str], idf: dict[str, float], threshold: float) -> list[str]:
    """The fewest of the heaviest terms such that a text without any of them cannot reach the threshold: what
    is left of each template's norm is below that share of it."""
    found: set[str] = set()
    for text in templates.values():
        w = _words(text)
        total = sum(idf[t] ** 2 for t in w)
        for t in sorted(set(w), key=lambda t: (-idf[t], t)):
            if sum(idf[x] ** 2 for x in w if x not in found) < threshold**2 * total:
                break
            found.add(t)
    return sorted(found)


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all whole texts each template term is, and the number of texts. The vocabulary is the
    templates', so what comes back is of a fixed size."""
    terms = F.array_intersect(F.split(F.lower("text"), _SPLIT), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(terms).alias("t")).groupBy("t").count().collect()
    return {t: 0 for t in vocabulary} | {r["t"]: r["count"] for r in found}, docs.count()


def _any(terms) -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(terms) + r")(?![\p{L}\p{N}])"


def lowered(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))


def matches(low: DataFrame, idf: dict[str, float], other: float, wanted: list[str], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, wide, line, license, cosine: each line of a lower-cased text (wide 1), the whole text as line -1
    (wide 1), and each 2 to WRAPPED adjacent lines, with the template whose TF-IDF cosine is highest and reaches
    the threshold, ties by name.

    Terms are weighted by count times idf over all texts; terms of no template enter the norm only. Units
    without an anchor term (see `anchors`) cannot match and are dropped before any term is exploded.
    """
    vocabulary, key = sorted(idf), ["doc_id", "wide", "line"]
    one = _any(wanted)
    texts = low.where(F.col("text").rlike(one))
    whole = texts.select("doc_id", F.lit(1).alias("wide"), F.lit(-1).alias("line"), "text")
    split = texts.select("doc_id", F.split("text", "\n", -1).alias("l"))
    units = whole.unionByName(split.select("doc_id", F.lit(1).alias("wide"), F.posexplode("l").alias("line", "text")).where(F.col("text").rlike(one)))
    for k in range(2, WRAPPED + 1):
        joined = split.where(F.size("l") >= k).select("doc_id", F.lit(k).alias("wide"), F.posexplode(F.expr(f"transform(sequence(1, size(l) - {k - 1}), i -> array_join(slice(l, i, {k}), ' '))")).alias("line", "text"))
        units = units.unionByName(joined.where(F.col("text").rlike(one)))
    units = units.select(*key, F.explode(F.split("text", _SPLIT)).alias("t")).where("t <> ''")
    known = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, idf[t])])
    counts = units.select(*key, F.when(F.col("t").isin(vocabulary), F.col("t")).alias("t"), F.xxhash64("t").alias("h"))
    tf = counts.groupBy(*key, "t", "h").agg(F.count("*").alias("n")).withColumn("w", F.col("n") * F.coalesce(F.try_element_at(known, F.coalesce("t", F.lit(""))), F.lit(other)))
    norms = [(name, math.sqrt(sum((_words(text).count(t) * idf[t]) ** 2 for t in set(_words(text))))) for name, text in templates.items()]
    rows = [f"('{t}', '{name}', {_words(text).count(t) * idf[t] / norm!r}D)" for (name, norm), text in zip(norms, templates.values(), strict=True) for t in sorted(set(_words(text)))]
    sparse = low.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(t, license, v)")
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.where("t IS NOT NULL").join(F.broadcast(sparse), "t").groupBy(*key, "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm, key).select(*key, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    return scored.groupBy(*key).agg(best.alias("b")).select(*key, "b.license", (-F.col("b.c")).alias("cosine"))


def full_weights(texts: dict[str, str] = TEXTS) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Of each licence text the weight of each term, of norm 1; idf of each term; the weight of all other terms.
    The idf is over the licence texts, so no weight depends on the table; terms of all of them weigh nothing."""
    counts = {name: Counter(_words(text)) for name, text in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(len(texts) / n) for t, n in df.items()}
    norms = {name: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for name, c in counts.items()}
    return {name: {t: n * idf[t] / norms[name] for t, n in c.items() if idf[t]} for name, c in counts.items()}, idf, math.log(len(texts))


def full_anchors(vectors: dict[str, dict[str, float]], full: float = FULL) -> list[str]:
    """As `anchors`: a text without any of these cannot reach the cosine with a licence text."""
    found: set[str] = set()
    for v in vectors.values():
        for t in sorted(v, key=lambda t: (-v[t], t)):
            if sum(x * x for y, x in v.items() if y not in found) < full**2:
                break
            found.add(t)
    return sorted(found)


def full_matches(low: DataFrame, texts: dict[str, str] = TEXTS, full: float = FULL) -> DataFrame:
    """doc_id, license, cosine of the lower-cased texts that are a licence text as a whole."""
    vectors, idf, other = full_weights(texts)
    sql = low.sparkSession.sql
    terms = low.where(F.col("text").rlike(_any(full_anchors(vectors, full)))).select("doc_id", F.explode(F.split("text", _SPLIT)).alias("t")).where("t <> ''")
    known = F.broadcast(sql(f"SELECT * FROM VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {x!r}D)' for t, x in sorted(idf.items()))} AS v(t, idf)"))
    tf = terms.groupBy("doc_id", "t").agg(F.count("*").alias("n")).join(known, "t", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    sparse = F.broadcast(sql(f"SELECT * FROM VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {chr(39)}{name}{chr(39)}, {x!r}D)' for name, v in vectors.items() for t, x in sorted(v.items()))} AS v(t, license, v)"))
    norm = tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.where("idf > 0").join(sparse, "t").groupBy("doc_id", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    return dots.join(norm, "doc_id").select("doc_id", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= full)


def _phrases(short: dict[str, str]) -> dict[str, str]:
    return {name: r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(_words(text)) + r"(?![\p{L}\p{N}])" for name, text in short.items()}


def short_matches(low: DataFrame, short: dict[str, str] = SHORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, license, cosine of the lines, and as line -1 the whole lower-cased texts, that hold a short header's
    words in a row and little else: the cosine is the root of the header's share of the words, at any size of
    the table."""
    phrases = _phrases(short)
    low = low.where(F.col("text").rlike("|".join(phrases.values())))
    units = low.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("line"), "text")), F.expr("transform(split(text, '\n', -1), (x, i) -> named_struct('line', i, 'text', x))"))).alias("u")).select("doc_id", "u.line", "u.text")
    forms = [F.when(F.col("text").rlike(phrases[name]), F.struct(F.lit(name).alias("license"), F.round(F.sqrt(F.lit(len(_words(text))) / F.col("n")), 6).alias("cosine"))) for name, text in short.items()]
    found = units.withColumn("n", F.size(F.array_remove(F.split("text", _SPLIT), ""))).select("doc_id", "line", F.explode(F.array(*forms)).alias("f"))
    return found.select("doc_id", "line", "f.license", "f.cosine").where(F.col("cosine") >= threshold)


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, cosine, origin, from_dir of every file of files (doc_id, path, text).

    A file whose whole text matches a template or is a licence text (see TEXTS) is a licence file and speaks for
    its directory; of several in one directory the smallest path does. A file with a matching line has that
    header (`header`, its best line; adjacent lines as one where no line matches); a licence file has its own
    (`file`); others inherit from the nearest ancestor directory that has a licence file (`inherited`,
    from_dir), or have none (`none`). Null and empty texts only inherit, and so do rows without a doc_id; a null path
    has no directory; rows that repeat a doc_id share their finding. Nearest ancestors are resolved once a directory, not once a file. Short
    headers (see SHORT) count in files without another match. Texts that may match are written once.
    """
    vocabulary = sorted({w for t in templates.values() for w in _words(t)})
    idf, other = weights(*document_frequencies(files, vocabulary))
    wanted = anchors(templates, idf, threshold)
    may = "|".join([_any(sorted({*wanted, *full_anchors(full_weights()[0])})), *_phrases(SHORT).values()])
    low = written(lowered(files).where(F.col("text").rlike(may)), "licences")
    # rank: whole text by template, licence text, line, adjacent lines, short header
    by_template = matches(low, idf, other, wanted, templates, threshold).withColumn("rank", F.when(F.col("line") < 0, 0).when(F.col("wide") == 1, 2).otherwise(3))
    full = full_matches(low).select("doc_id", F.lit(-1).alias("line"), "license", "cosine", F.lit(1).alias("rank"))
    found = by_template.drop("wide").unionByName(full).unionByName(short_matches(low).withColumn("rank", F.lit(4)))
    own = found.groupBy("doc_id").agg(F.min(F.struct("rank", (F.col("line") >= 0).alias("h"), (-F.col("cosine")).alias("c"), "license")).alias("b"))
    own = own.select("doc_id", F.col("b.license").alias("own"), (-F.col("b.c")).alias("own_cosine"), F.when(F.col("b.h"), "header").otherwise("file").alias("own_origin"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    placed = files.select("doc_id", "path", folder.alias("dir"))
    licensed = placed.join(own.where("own_origin = 'file'"), "doc_id").where("dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own", "own_cosine")).alias("f"))
    dirs = placed.select("dir").where("dir IS NOT NULL").distinct()
    chain = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), i -> named_struct('depth', i, 'up', array_join(slice(split(dir, '/'), 1, i), '/')))")).alias("a")).select("dir", "a.depth", F.col("a.up").alias("up"))
    near = chain.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "f")).alias("n"))
    near = near.select("dir", F.col("n.up").alias("from_dir"), F.col("n.f.own").alias("above"), F.col("n.f.own_cosine").alias("above_cosine"))
    out = placed.join(own, "doc_id", "left").join(near, "dir", "left")
    origin = F.coalesce("own_origin", F.when(F.col("above").isNotNull(), "inherited"), F.lit("none"))
    return out.select("doc_id", "path", F.coalesce("own", "above").alias("license"), F.coalesce("own_cosine", "above_cosine").alias("cosine"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
