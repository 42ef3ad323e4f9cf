"""The registered query of each operator: its production parameters, its whole table, its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table


def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.ego_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.line_dedup import drop_lines

    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The dated list that op4 evaluates: (kind, pattern, action, at).
LIST_EVENTS = [
    ("domain", "spam-farm.example.org", "add", "2024-01-15 00:00:00"),
    ("domain", "spam-farm.example.org", "remove", "2024-05-01 00:00:00"),
    ("domain", "spam-farm.example.org", "add", "2024-09-01 00:00:00"),
    ("domain", "cheap-pills.example.com", "add", "2024-03-01 00:00:00"),
    ("host", "blog.ththan.example.net", "add", "2024-02-01 00:00:00"),
    ("host", "blog.ththan.example.net", "remove", "2024-08-01 00:00:00"),
    ("domain", "ththed.example.org", "add", "2024-04-10 00:00:00"),
    ("domain", "ththed.example.org", "remove", "2024-10-10 00:00:00"),
    ("prefix", "ththin.example.com/en", "add", "2024-06-01 00:00:00"),
    ("prefix", "https://thther.example.org/en", "add", "2024-02-15 00:00:00"),
    ("prefix", "https://thther.example.org/en", "remove", "2024-11-15 00:00:00"),
    ("host", "www.ththwh.example.org", "remove", "2024-03-01 00:00:00"),
]


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of pages has no fetch time: a day of 2024 drawn from the page id stands in for it."""
    from foliant.llm.url_lists import filter_urls

    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).cast("timestamp")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    events = spark.createDataFrame(LIST_EVENTS, "kind string, pattern string, action string, at string")
    return filter_urls(captures, events).select("page_id", "host", "blocked", "rule_kind", "rule", F.date_format("listed_since", "yyyy-MM-dd").alias("listed_since"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the host and the language for the section below it."""
    from foliant.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_fit=20_000)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foliant.llm.spiece import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive as one append of small shards and are compacted; each is then read from the shard that holds it."""
    import uuid

    from foliant.llm.common import shared_dir
    from foliant.llm.compaction import ShardStore

    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=128 << 20, fan_in=4)
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum(keep=1)
    in_shard = (F.col("shard") >= 0) & (F.col("shard_rows") > 0) & (F.col("version") > 0)
    return store.read().select("doc_id", in_shard.alias("in_shard"), F.sha2("text", 256).alias("text_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ego_join": op1_ego_join,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_lists": op4_url_lists,
    "op5_simhash": op5_simhash,
    "op6_site_quality": op6_site_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_compaction": op8_compaction,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
}

#: DuckDB SQL. A-Z are lower-cased by translate(), which leaves other letters alone.
LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, doc_id, u.i AS i, u.line AS line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT r, doc_id, unnest(list_zip(string_split(text, chr(10)),
                                          range(len(string_split(text, chr(10)))))) AS z FROM docs),
       LATERAL (SELECT z[1] AS line, z[2] AS i) u),
common AS (SELECT line_key FROM lines WHERE length(line_key) >= 1
           GROUP BY line_key
           HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN r END) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(c.line_key) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.line_key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.line_key = c.line_key
GROUP BY l.r, l.doc_id
"""

EGO_JOIN_SQL = """
WITH RECURSIVE rows AS (SELECT *, row_number() OVER () AS r FROM embeddings),
v AS (
  SELECT r, label, CAST(embedding AS DOUBLE[]) AS e FROM rows
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b
          ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT reach.a, min(rows.vec_id) AS low FROM reach JOIN rows ON rows.r = reach.b GROUP BY reach.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)), true) AS kept
FROM rows e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.r
LEFT JOIN low c ON c.a = e.r
"""

URL_LISTS_SQL = r"""
WITH events(kind, pattern, action, moment) AS (VALUES
  {events}),
named AS (
  SELECT kind, action, CAST(moment AS TIMESTAMP) AS moment,
         CASE WHEN kind = 'prefix'
              THEN lower(regexp_extract(bare, '^(?:[^/@]*@)?([^/:]*)', 1)) || regexp_extract(bare, '^[^/]*(.*?)/*$', 1)
              ELSE lower(regexp_extract(bare, '^(?:[^/@]*@)?([^/:]*)', 1)) END AS pattern
  FROM (SELECT *, regexp_replace(pattern, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM events)),
single AS (SELECT kind, pattern, moment, max(action) AS action FROM named GROUP BY ALL),
listed AS (
  SELECT * FROM (SELECT kind, pattern, action, moment AS since,
                        lead(moment) OVER (PARTITION BY kind, pattern ORDER BY moment) AS until FROM single)
  WHERE action = 'add'),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT c.page_id, l.kind, l.pattern, l.since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY
           CASE l.kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC, length(l.pattern) DESC) AS place
  FROM captures c JOIN listed l
    ON c.host <> '' AND c.fetched >= l.since AND (l.until IS NULL OR c.fetched < l.until)
   AND CASE l.kind WHEN 'host' THEN c.host = l.pattern
                   WHEN 'domain' THEN c.host = l.pattern OR ends_with(c.host, '.' || l.pattern)
                   ELSE c.host = l.pattern OR c.host || c.path = l.pattern OR starts_with(c.host || c.path, l.pattern || '/') END)
SELECT c.page_id, coalesce(c.host, '') AS host, h.page_id IS NOT NULL AS blocked, h.kind AS rule_kind, h.pattern AS rule,
       strftime(h.since, '%Y-%m-%d') AS listed_since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1
""".replace("{events}", ",\n  ".join(str(e) for e in LIST_EVENTS))

ORACLE_SQL: dict[str, str] = {
    "op1_ego_join": EGO_JOIN_SQL,
    "op3_line_dedup": LINE_DEDUP_SQL,
    "op4_url_lists": URL_LISTS_SQL,
    "op8_compaction": "SELECT doc_id, true AS in_shard, sha256(text) AS text_sha256 FROM documents",
}
