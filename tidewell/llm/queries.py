"""The registered queries of these operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    bpe,
    interactions,
    jaccard,
    lines,
    middles,
    mixing,
    sharding,
    suffixes,
    syncmers,
    topk,
    toxicity,
    url_rules,
    vptree,
)

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 10
    """
)
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query()
def op5_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


@query()
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("set_id")


@query(
    """
    WITH p AS (
      SELECT page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    r(rule_host, rule_path, rule_verdict) AS (VALUES
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    f AS (
      SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY host, path
                                ORDER BY length(rule_host) + length(rule_path) DESC) AS k
      FROM (SELECT DISTINCT host, path FROM p) d
      JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
    FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path AND f.k = 1
    """
)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, url_rules.RULES)
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query(
    r"""
    WITH p AS (
      SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
    u AS (SELECT doc_id, text, unnest(parts) AS part, unnest(range(len(parts))) AS unit FROM p),
    n AS (
      SELECT *, trim(regexp_replace(lower(part), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal,
             coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY unit
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM u),
    m AS (
      SELECT *, normal <> '' AND
             row_number() OVER (PARTITION BY normal ORDER BY doc_id, unit) > 1 AS gone
      FROM n)
    SELECT doc_id, count(*) AS n_units, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS removed_units,
           CAST(coalesce(sum(strlen(part)) FILTER (gone), 0) AS BIGINT) AS n_removed,
           coalesce(string_agg(start || ':' || length(part), ' ' ORDER BY unit) FILTER (gone), '') AS removed,
           sha256(coalesce(string_agg(part, chr(10) ORDER BY unit) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["length"].cast("string")))
    return lines.repeated_units(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_units",
        "n_removed",
        "removed_units",
        F.array_join(spans, " ").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query()
def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.written(F.col("fingerprint")).alias("fingerprint"),
        syncmers.written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query(
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
             sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM documents),
    r AS (
      SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS r1,
             ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS r2,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM d),
    p AS (
      SELECT *, array_to_string(units[1:least(r1, r2)], '') AS prefix,
             array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
             array_to_string(units[greatest(r1, r2) + 1:], '') AS suffix
      FROM r),
    o AS (
      SELECT *, CASE form WHEN 'plain' THEN text
                          WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                          ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
      FROM p)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(output) AS output_sha256,
           sha256(CASE form
             WHEN 'plain' THEN output
             WHEN 'psm' THEN regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 1)
               || regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 3)
               || regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 2)
             ELSE regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 2)
               || regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 3)
               || regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 1) END) AS restored_sha256
    FROM o
    """
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.restore(middles.transform(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@query(
    r"""
    WITH flags AS (
      SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
      FROM labels GROUP BY doc_id),
    w AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    f AS (
      SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             MAP {'A': len(words) < 100,
                  'B': 100 * len(list_distinct(words)) < 80 * len(words),
                  'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
                  'D': regexp_matches(text, '[#$%&*|]'),
                  'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text),
                                min(w.doc_id) OVER (PARTITION BY text) IS NOT NULL)} AS fails
      FROM w LEFT JOIN flags ON w.doc_id = flags.doc_id),
    counts AS (
      SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
    letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, s AS step, filter_order[s] AS filter FROM orders, range(1, 6) t(s)),
    met AS (
      SELECT part, filter_order, step, filter, good, toxic, n, fails[filter] AS fail,
             len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND fails[x])) > 0 AS gone,
             len(list_filter(map_values(fails), lambda x: x)) AS all_fails
      FROM counts, steps),
    found AS (
      SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
             CAST(sum(n * CAST(NOT gone AND NOT fail AS INTEGER)) AS BIGINT) AS kept,
             CAST(sum(n * CAST(NOT gone AND fail AS INTEGER)) AS BIGINT) AS removed,
             CAST(sum(n * CAST(gone AND fail AS INTEGER)) AS BIGINT) AS redundant,
             CAST(sum(n * CAST(fail AND all_fails = 1 AS INTEGER)) AS BIGINT) AS unique_fails,
             CAST(sum(n * good * CAST(NOT gone AND fail AS INTEGER)) AS BIGINT) AS good_lost,
             CAST(sum(n * toxic * CAST(NOT gone AND fail AS INTEGER)) AS BIGINT) AS toxic_lost
      FROM met GROUP BY part, filter_order, step, filter)
    SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM found
    """
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return interactions.audit(interactions.failures(documents, labels))
