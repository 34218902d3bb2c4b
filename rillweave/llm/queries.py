"""The ten operators as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import fresh_path, spread
from .exact_dedup import exact_dedup
from .lloyd import lloyd_clusters
from .mixing import mix_sources
from .perplexity_rules import quality_rules
from .phrase_dedup import phrase_dedup
from .projected_search import nearest_neighbours
from .quality_classifier import quality_scores
from .simhash_dedup import simhash_groups
from .source_divergence import source_divergence
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .warc import page_of, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found if name == "labels" else spread(found)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=3)


def _removed(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_table(spark, sf_dir, "documents"), length=200, keep_first=False)
    return found.select("doc_id", "n_bytes", _removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path)
    # An archive just written has no gaps; a page must not go missing without an error.
    back = back.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("gap in a written archive: "), F.col("gap"))).cast("boolean")))
    digest = F.when(F.col("warc_type") == "revisit", F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256))
    return back.select(page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), page_of("refers_to").alias("refers_to"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_encode(_table(spark, sf_dir, "documents"), ranks, pattern, round_trip=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup(_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", _removed("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd_clusters(_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_suffix, op4_exact, op5_warc, op6_bpe, op7_phrase, op8_tokens, op9_mixing, op10_rules, op11_neighbours, op12_lloyd, op13_divergence)}



def _lloyd_sql(rounds: int = 3) -> str:
    """Lloyd's rounds as one query, each round three steps of it: distances, assignment, centroids."""
    steps = [
        r"""v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64 AND len(embedding) = 64),
        e AS (SELECT vec_id, unnest(generate_series(1, 64)) AS j, unnest(x) AS a FROM v),
        s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS k, x FROM v QUALIFY k < 16),
        c0 AS (SELECT k, unnest(generate_series(1, 64)) AS j, unnest(x) AS b FROM s)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT vec_id, k, sum((a - b) * (a - b)) AS d FROM e JOIN c{i} USING (j) GROUP BY vec_id, k)")
        steps.append(f"a{i} AS (SELECT vec_id, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT k, j, ((sum(a) - ((sum(a) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS b FROM a{i} JOIN e USING (vec_id) GROUP BY k, j)")
            steps.append(f"c{i + 1} AS (SELECT c.k, c.j, coalesce(m.b, c.b) AS b FROM c{i} c LEFT JOIN m{i} m USING (k, j))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(b::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    rest = f"SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (k)"
    return "WITH " + ",\n        ".join(steps) + "\n        " + rest


ORACLE_SQL = {
    "op12_lloyd": _lloyd_sql(),
    "op3_suffix": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(generate_series(0, n - 200)) AS u(i) WHERE n >= 200),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS times FROM w) WHERE times > 1),
        marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
        pieces AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
        sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id
    """,
    "op4_exact": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op5_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        p AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM t),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM g
    """,
    "op7_phrase": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS k FROM d, unnest(generate_series(1, len(words) - 34)) AS u(i)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
        covered AS (SELECT DISTINCT doc_id, p FROM again, unnest(generate_series(i, i + 34)) AS u(p)),
        each AS (SELECT doc_id, p, words[p] AS word FROM d, unnest(generate_series(1, len(words))) AS u(p)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op9_mixing": r"""
        WITH s AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM documents GROUP BY source),
        r AS (SELECT source, CASE WHEN bytes > 0 THEN sum(bytes) OVER () * (pow(bytes, 0.5) / sum(pow(bytes, 0.5)) OVER ()) / bytes ELSE 0 END AS rate FROM s),
        k AS (SELECT source, rate, k FROM r, unnest(generate_series(0, ceil(rate + 10 * sqrt(rate) + 20)::BIGINT)) AS u(k) WHERE rate > 0),
        c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
        u AS (SELECT *, (('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS chance FROM documents),
        n AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND cdf < chance)::INTEGER AS n_copies FROM u)
        SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, n_copies,
               ('0x' || substr(sha256('17+:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no::VARCHAR), 1, 12))::BIGINT AS shuffle_key
        FROM n, unnest(generate_series(1, n_copies)) AS v(copy_no)
    """,
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS q
              FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 10
    """,
}
