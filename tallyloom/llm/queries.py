"""One query for each operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, dialogue, fingerprint, html_text, line_dedup, mixing, near_dup, resample, substring_dedup, suffix_dedup, toxicity, url_filter, vector_search
from tallyloom.llm.url_filter import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_url_filter",
    r"""
    WITH u AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    m AS (
      SELECT *, '.' || host AS h, CASE
        WHEN h LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
        WHEN h LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
        WHEN h LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN h LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
        WHEN h LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
      FROM u)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict
    FROM m""",
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op9_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
        [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight
      FROM d GROUP BY source),
    p AS (
      SELECT *,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS rest,
        (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS heavy,
        row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS nth
      FROM s WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT rest AS l_rest, heavy AS l_heavy FROM p WHERE rest * weight <= cap * heavy ORDER BY nth LIMIT 1),
    t AS (SELECT source, source_size, least(cap::DOUBLE, (weight * l_rest) / l_heavy) AS target FROM p, l),
    r AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0) AS rate,
        ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM r""",
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_near_dup")
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=2)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


@query("op4_fingerprint")
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query(
    "op7_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query(
    "op2_line_dedup",
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS pos FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, lower(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'))) AS norm FROM l),
    b AS (SELECT doc_id, pos, norm, row_number() OVER d AS no, lead(norm) OVER d AS norm2, lead(pos) OVER d AS pos2, count(*) OVER (PARTITION BY doc_id) AS n
      FROM n WHERE norm <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    v AS (SELECT doc_id, no, pos, pos2, norm, norm2 FROM b WHERE norm2 IS NOT NULL
      UNION ALL SELECT doc_id, no, pos, NULL, norm, NULL FROM b WHERE n = 1 OR len(string_split(norm, ' ')) >= 20),
    w AS (SELECT doc_id, pos, pos2, row_number() OVER (PARTITION BY norm, norm2 ORDER BY doc_id, no) AS nth FROM v),
    g AS (SELECT doc_id, pos FROM w WHERE nth > 1 UNION SELECT doc_id, pos2 FROM w WHERE nth > 1 AND pos2 IS NOT NULL),
    k AS (SELECT n.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN n.line END, chr(10) ORDER BY n.pos) AS kept, bool_or(g.pos IS NULL AND n.norm <> '') AS any_left, count(g.pos)::INTEGER AS n_removed
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
    SELECT d.doc_id, CASE WHEN coalesce(k.n_removed, 0) = 0 THEN d.text WHEN k.any_left THEN k.kept ELSE '' END AS text, coalesce(k.n_removed, 0)::INTEGER AS n_removed
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("gone").alias("n_removed"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents")))


@query("op12_resample")
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_dialogue_repair")
def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_damaged(table(spark, sf_dir, "conversations"))
