"""The ten operators as registered queries, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import decontaminate, langid, licenses, neardup, packing, sharding, suffixes, tokens, topk, toxicity
from blockweave.llm.common import table, written


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts in two batches, a deletion, a revision and replays; they equal a recount."""
    docs = table(spark, sf_dir, "documents")
    counts = written(tokens.token_counts(docs), "counts").withColumn("tokenizer", F.lit(f"{tokens.VOCABULARY}/1"))
    even, third = F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    even, third = F.coalesce(even, F.lit(True)), F.coalesce(third, F.lit(False))
    plus, minus = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    keys = ["source", "lang", "tokenizer", "n_tokens"]
    rollup = tokens.new_rollup(spark)
    inserts = {"0": counts.where(even).select(*keys, plus), "1": counts.where(~even).select(*keys, plus)}
    for batch, rows in inserts.items():
        rollup.commit(batch, rows)
    rollup.commit("2", counts.where(third).select(*keys, minus))
    rollup.commit("1", inserts["1"])
    stale = counts.where(third).withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.commit("3", stale.select(*keys, plus))
    rollup.commit("4", stale.select(*keys, minus).unionByName(counts.where(third).select(*keys, plus)))
    rollup.compact()
    rollup.vacuum()
    rollup.commit("3", stale.select(*keys, plus))
    return rollup.totals()


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def _crc(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where((_crc(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = langid.identify(docs, *langid.fit(labelled))
    return found.select("doc_id", F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def toxicity_grammar(spark: SparkSession, sf_dir: str) -> toxicity.Grammar:
    """Learned from the labelled documents outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where((_crc(3) != 1) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    return toxicity.learn(docs, known)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.rate(table(spark, sf_dir, "documents"), toxicity_grammar(spark, sf_dir))
    return found.select("doc_id", F.coalesce(_crc(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "matched")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


QUERIES = {f.__name__: f for f in (op1_minhash_neardup, op2_decontamination, op3_token_counts, op4_suffix_dedup, op5_language_id, op6_license_scan, op7_toxicity, op8_best_fit_packing, op9_exact_topk, op10_sharding)}

_N, _M = len(sharding.SHARDS), sharding.SLOTS
ORACLES = {
    "op1_minhash_neardup": r"""
        WITH RECURSIVE w AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
        sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 2 THEN list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) ELSE l END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT DISTINCT a AS v, a AS r FROM sym UNION SELECT reach.v, sym.b FROM reach JOIN sym ON sym.a = reach.r)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(r), w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(min(r), w.doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.v = w.doc_id GROUP BY w.doc_id, n.n""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
        win AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM b WHERE n >= 100)),
        late AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
        edge AS (SELECT doc_id, p, coalesce(p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, true) AS fresh FROM late),
        isle AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edge),
        span AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS z FROM isle GROUP BY ALL),
        gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span UNION ALL SELECT doc_id, max(z), 1000000000 FROM span GROUP BY doc_id),
        rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM gap JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT b.doc_id, n AS n_bytes, CAST(coalesce((SELECT sum(z - a) FROM span WHERE span.doc_id = b.doc_id), 0) AS BIGINT) AS n_removed, CAST((SELECT count(*) FROM span WHERE span.doc_id = b.doc_id) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM b LEFT JOIN rest ON rest.doc_id = b.doc_id""",
    "op6_license_scan": f"""
        WITH tpl(license, text) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())}),
        tw AS (SELECT license, t, count(*) AS n FROM (SELECT license, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM tpl) WHERE t <> '' GROUP BY ALL),
        size AS (SELECT count(*) AS n FROM documents),
        df AS (SELECT t, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM documents) WHERE t IN (SELECT t FROM tw) GROUP BY t),
        idf AS (SELECT DISTINCT tw.t, ln((size.n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM tw LEFT JOIN df USING (t), size),
        vec AS (SELECT license, tw.t, n * idf / sqrt(sum(n * n * idf * idf) OVER (PARTITION BY license)) AS v FROM tw JOIN idf USING (t)),
        units AS (SELECT doc_id, -1 AS line, lower(text) AS text FROM documents
                  UNION ALL SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS l FROM documents)),
        tok AS (SELECT doc_id, line, t, count(*) AS n FROM (SELECT doc_id, line, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS t FROM units) WHERE t <> '' GROUP BY ALL),
        tf AS (SELECT doc_id, line, tok.t, tok.n * coalesce(idf, ln(size.n + 1) + 1) AS w FROM tok LEFT JOIN idf ON idf.t = tok.t, size),
        norm AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM tf GROUP BY ALL),
        dots AS (SELECT doc_id, line, license, sum(w * v) AS dot FROM tf JOIN vec USING (t) GROUP BY ALL),
        scored AS (SELECT doc_id, line, license, round(dot / norm, 6) AS cosine FROM dots JOIN norm USING (doc_id, line) WHERE round(dot / norm, 6) >= {licenses.THRESHOLD}),
        best AS (SELECT doc_id, line, license, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY cosine DESC, license) = 1),
        own AS (SELECT doc_id, license AS own, cosine AS own_cosine, CASE WHEN line < 0 THEN 'file' ELSE 'header' END AS own_origin FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line >= 0, cosine DESC, license) = 1),
        placed AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id AS path, coalesce(source, '') || '/' || coalesce(lang, '') AS dir FROM documents),
        licensed AS (SELECT dir, path, own, own_cosine FROM placed JOIN own USING (doc_id) WHERE own_origin = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1),
        near AS (SELECT d.dir, l.dir AS from_dir, own AS above, own_cosine AS above_cosine FROM (SELECT DISTINCT dir FROM placed) d JOIN licensed l ON l.dir = '' OR d.dir = l.dir OR starts_with(d.dir, l.dir || '/') QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) = 1)
        SELECT doc_id, path, coalesce(own, above) AS license, coalesce(own_cosine, above_cosine) AS cosine, coalesce(own_origin, CASE WHEN above IS NOT NULL THEN 'inherited' END, 'none') AS origin, CASE WHEN own IS NULL THEN from_dir END AS from_dir
        FROM placed LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)""",
    "op9_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op10_sharding": f"""
        WITH RECURSIVE o AS (SELECT i, CAST('0x' || substr(md5(format('shard-{{:02d}}', i)), 1, 8) AS BIGINT) % {_M} AS o, CAST('0x' || substr(md5(format('shard-{{:02d}}', i)), 9, 8) AS BIGINT) % {_M - 1} + 1 AS k FROM range({_N}) r(i)),
        pref AS (SELECT i, list((o + j * k) % {_M} ORDER BY j) AS p FROM o, range({_M}) r(j) GROUP BY i),
        prefs AS (SELECT list(p ORDER BY i) AS p FROM pref),
        fill AS (SELECT 0 AS turn, []::BIGINT[] AS taken
                 UNION ALL
                 SELECT turn + 1, list_append(taken, list_filter(p[turn % {_N} + 1], lambda s: NOT list_contains(taken, s))[1]) FROM fill, prefs WHERE turn < {_M}),
        t AS (SELECT unnest(taken) AS slot, unnest(range({_M})) AS turn FROM fill WHERE turn = {_M})
        SELECT doc_id, slot, format('shard-{{:02d}}', turn % {_N}) AS shard
        FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {_M} AS slot FROM documents) JOIN t USING (slot)""",
}
