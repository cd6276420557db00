"""The operators' queries over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, clusters, divergence, exact_dedup, licenses, line_dedup, near_dup, packing, quality, substring_dedup, token_counts, toxicity
from .common import saved, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0")
    return ann.search(queries, vectors, queries.count(), vectors.count())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def edits():
    """Three edits of each document, at places that follow from its id: a word put in, some characters taken out, some replaced."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def change(k: int, width: int, new: str):
        at = F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1)
        return F.struct(at.alias("start"), (at + width).alias("end"), F.lit(new).alias("new"))

    return F.array(change(1, 0, " revised"), change(2, 20, ""), change(3, 5, "\n 2nd edition's"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees' leaves are stored first; the edits then work on what is stored."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = saved(token_counts.build(table(spark, sf_dir, "documents"), *vocabulary), "zstd")
    after = token_counts.follow(state.withColumn("edits", edits()), *vocabulary)
    return after.select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", F.sha2("text", 256).alias("edited_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the ids is the history, the rest arrives."""
    docs = table(spark, sf_dir, "documents")
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    return exact_dedup.exact_dedup(docs.where(old), docs.where(~old), rows)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~quality.held_out()))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings")).drop("compared")


def _clusters_sql() -> str:
    """The ten rounds one after another: c0 to c10 are centroids, a0 to a10 vectors with the nearest of them."""
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS p FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, p FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)"""]
    for k in range(11):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
            SELECT v.r, c.cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.p, c.p)])::BIGINT AS d FROM v CROSS JOIN c{k} c) GROUP BY r)""")
        if k < 10:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.p, c.p) AS p FROM c{k} c LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM (
                    SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.cluster, unnest(v.p) AS x, unnest(range(64)) AS i FROM v JOIN a{k} a USING (r)) GROUP BY ALL) GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {', '.join(steps)}
        SELECT vec_id, a.cluster::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.p, ',')) AS centroid_sha256
        FROM v JOIN a10 a USING (r) JOIN c10 c USING (cluster)"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_quality": op11_quality,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroid_clusters": op13_centroid_clusters,
}

SQL = {
    "op2_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
        c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
        t AS (SELECT doc_id, k, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
        u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM t WHERE line <> ''),
        w AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM u),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM w WHERE b IS NOT NULL),
        s AS (SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM u WHERE length(line) >= 40),
        gone AS (SELECT u.doc_id, u.k FROM r JOIN u ON u.doc_id = r.doc_id AND u.i IN (r.i, r.i + 1) WHERE r.n > 1 UNION SELECT doc_id, k FROM s WHERE n > 1),
        kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS text FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY l.doc_id)
        SELECT d.doc_id, (SELECT count(*) FROM u WHERE u.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM d WHERE len(words) >= 50),
        w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS own FROM s),
        r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY own) AS low FROM w) WHERE low < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM r),
        u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
        h AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        f AS (SELECT g.lang, g.source, h.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN h USING (lang) LEFT JOIN c USING (lang, source, term)),
        l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
        p AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f),
        q AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
        t AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM o))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_centroid_clusters": _clusters_sql(),
}
