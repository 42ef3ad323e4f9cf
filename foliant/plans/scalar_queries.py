"""Queries for the column functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions import digest, geometry, text, uri
from foliant.operators import resolve


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- pieces of SQL


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_norm(x: str) -> str:
    for a, b in K.FOLDED.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def sql_label(x: str) -> str:
    return rf"regexp_extract({x}, '^[\s.·•()\[\]-]*([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,10}})[\s.·•()\[\]-]*$', 1)"


def sql_roman(x: str) -> str:
    form = "^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    places = " + ".join(f"{place} * (list_position({sql_list(digits)}, regexp_extract(upper({x}), '{form}', {i + 1})) - 1)" for i, (place, digits) in enumerate(text.ROMAN.items()))
    return f"CASE WHEN {x} <> '' AND regexp_matches(upper({x}), '{form}') THEN CAST({places} AS INTEGER) END"


def sql_number(core: str) -> str:
    return f"CASE WHEN regexp_matches({core}, '^[0-9]') THEN TRY_CAST({core} AS INTEGER) ELSE {sql_roman(core)} END"


FIRST_SENTENCE = "^[^.!?]*"
TOKENS_SQL = r"tokens AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS token FROM documents) WHERE token <> '' GROUP BY token)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct blank-separated words of all documents with their number; equal words meet before the exchange."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f\x0b]+")).alias("token"))
    return words.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


URI_SQL = {}
_VALUE = r"""rtrim(ltrim(regexp_replace(token, '^\s+|\s+$', '', 'g'), '([{<''"'), '.,;:!?)]}>''"')"""
_EMAIL, _WEB, _DOMAIN = f"regexp_matches(v, '^{K.EMAIL}$')", f"regexp_matches(v, '^{K.WEB}$', 'i')", f"regexp_matches(v, '^{K.DOMAIN}$')"
SQL_URI = f"CASE WHEN {_EMAIL} THEN 'mailto:' || v WHEN {_WEB} THEN CASE WHEN regexp_matches(v, '^https?://', 'i') THEN v ELSE 'https://' || v END END"
SQL_URI_BARE = f"CASE WHEN {_EMAIL} OR {_WEB} THEN {SQL_URI} WHEN {_DOMAIN} AND NOT list_contains({sql_list(K.BLOCKED_FILE_TLDS)}, lower(regexp_extract(v, '^[^/:]*\\.([^./:]+)(?:[:/]|$)', 1))) THEN 'https://' || v END"
SQL_SUPPORTED = "coalesce(regexp_matches({u}, '^" + K.SUPPORTED + "', 'i'), false)"
_ADDRESSES = f"addresses AS (SELECT token FROM tokens UNION SELECT url FROM pages UNION SELECT regexp_extract(url, '://([^/?#]*)', 1) FROM pages UNION SELECT '(' || regexp_extract(url, '://([^/?#]*)', 1) || '/a.' FROM pages)"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    # an address holds a full stop, a colon or an at sign; other words needn't be counted
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f\x0b]+")).alias("token")).where(F.col("token").rlike("[.:@]")).distinct()
    return words.union(pages.select("url")).union(pages.select(host)).union(pages.select(F.concat(F.lit("("), host, F.lit("/a.")))).distinct()


def q_normalize_text(spark, d):
    n = text.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(n).alias("n_chars_left"), F.sha2(n, 256).alias("digest"))


def q_parse_page_label(spark, d):
    return tokens(spark, d).withColumn("label", text.parse_page_label(F.col("token"))).where("label is not null").select("token", "n", F.col("label.number").alias("number"), F.col("label.kind").alias("kind"))


def q_roman_to_int(spark, d):
    return tokens(spark, d).where(F.col("token").rlike("^[ivxlcdmIVXLCDM]{1,10}$")).select("token", text.roman_to_int(F.col("token")).alias("value"))


def q_int_to_roman(spark, d):
    n = (F.col("o_orderkey") % 4100).cast("int")
    return table(spark, d, "orders").select("o_orderkey", text.int_to_roman(n).alias("numeral"), text.roman_to_int(text.int_to_roman(n)).alias("back"))


def q_ordinal_token(spark, d):
    return tokens(spark, d).where(text.ordinal_token(F.col("token")))


def q_roman_like(spark, d):
    return tokens(spark, d).where(text.roman_like(F.col("token")))


def q_toc_title_clean(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    dots = F.concat(F.col("line"), F.when(F.col("line_no") % 3 == 0, " .....").when(F.col("line_no") % 3 == 1, " .. •• ").otherwise(" - "))
    return lines.select("doc_id", "line_no", F.sha2(text.clean_title(dots), 256).alias("digest"))


def q_title_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.title_tokens(text.normalize_text(F.col("text"))), " ").alias("tokens"))


def titles(spark, d):
    """The first sentence of an item is its title."""
    return table(spark, d, "benchmark").select("item_id", text.normalize_text(F.regexp_extract("text", FIRST_SENTENCE, 0)).alias("plain"))


def titled(spark, d):
    """Every item as a title with the documents, as pages, that share words with it."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("candidate"), text.normalize_text(F.col("text")).alias("normalized_text"))
    return resolve.titles_on_pages(titles(spark, d), pages, ["item_id"], [])


def q_title_match_score(spark, d):
    return titled(spark, d).where("score > 0.4").select("item_id", F.col("candidate").alias("doc_id"), F.round("score", 6).alias("score"))


def q_title_candidates(spark, d):
    return titled(spark, d).where("exact").select("item_id", F.col("candidate").alias("doc_id"))


def q_title_unique(spark, d):
    found = resolve.unique_title(titled(spark, d), ["item_id"])
    out = titles(spark, d).select("item_id").join(found, "item_id", "left")
    return out.select("item_id", "destination", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


_STOP = sql_list(K.STOPWORDS)
_TITLED_SQL = f"""titles AS (SELECT item_id, {sql_norm(f"regexp_extract(text, '{FIRST_SENTENCE}')")} AS title FROM benchmark),
pages_ AS (SELECT doc_id, {sql_norm("text")} AS page FROM documents),
both_ AS (SELECT item_id, doc_id, title, page, list_filter(string_split(title, ' '), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)) AS useful FROM titles, pages_),
titled AS (SELECT item_id, doc_id, contains(page, title) AS exact, CASE WHEN length(title) < 5 THEN 0.0 WHEN contains(page, title) THEN 1.0 WHEN len(useful) < 2 THEN 0.0
  ELSE len(list_intersect(list_distinct(useful), list_distinct(string_split(page, ' ')))) / len(list_distinct(useful)) END AS score FROM both_)"""


def q_normalized_uri(spark, d):
    u = addresses(spark, d).select("token", uri.normalized_uri(F.col("token")).alias("uri"), uri.normalized_uri(F.col("token"), True).alias("uri_bare"))
    return u.where("uri is not null or uri_bare is not null")


def q_supported_uri(spark, d):
    u = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?://", "")).when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "^https?://[^/]*", "http://")).when(F.col("page_id") % 5 == 2, F.concat(F.lit("mailto:a"), F.when(F.col("page_id") % 2 == 0, "@").otherwise("?@"), F.lit("b.org"))).otherwise(F.col("url")).alias("uri"))
    return u.select("page_id", "uri", uri.supported_uri(F.col("uri")).alias("supported"))


def q_repo_url(spark, d):
    p = F.col("page_id")
    owner, name = F.concat(F.lit("Own-"), (p % 7).cast("string")), F.concat(F.lit("Repo."), p.cast("string"))
    url = F.when(p % 6 == 0, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git"))).when(p % 6 == 1, F.concat(F.lit("git@github.com:"), owner, F.lit("/"), name)).when(p % 6 == 2, F.concat(F.lit("ssh://git@github.com/"), owner, F.lit("/"), name, F.lit("/"))).when(p % 6 == 3, F.concat(F.lit("https://github.com/"), owner)).when(p % 6 == 4, F.col("url")).otherwise(F.concat(F.lit("https://user@github.com/"), owner, F.lit("/"), name))
    return table(spark, d, "pages").select("page_id", text.repository_url(url).alias("repository"))


def q_page_list(spark, d):
    given = F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit(", "), (F.col("n_nationkey") % 5 + 1).cast("string"), F.lit(",,"), (F.col("n_regionkey") + 1).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(text.page_list(given, F.lit(5)), " ").alias("pages"))


def q_requirement_pin(spark, d):
    line = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_.")), F.when(F.col("p_size") % 3 == 0, F.lit(" == ")).when(F.col("p_size") % 3 == 1, F.lit("==")).otherwise(F.lit(">=")), F.col("p_size").cast("string"), F.lit(".0 # pin"))
    pins = table(spark, d, "part").select(text.requirement_pin(line).alias("pin")).where("pin is not null").select("pin.*")
    return pins.groupBy("name").agg(F.countDistinct("version").alias("versions"), F.min("version").alias("first_version"), (F.countDistinct("version") > 1).alias("conflict"))


def rects(spark, d):
    """Rectangles of the first four components; two hundred vectors make a document, a label is a page."""
    e = lambda i: F.col("embedding")[i].cast("double")
    r = F.array(F.least(e(0), e(1)), F.least(e(2), e(3)), F.greatest(e(0), e(1)), F.greatest(e(2), e(3)))
    return table(spark, d, "embeddings").where("label is not null and size(embedding) >= 4").select("vec_id", F.expr("vec_id div 200").alias("doc_id"), F.col("label").alias("page_index"), r.alias("rect"))


RECTS_SQL = """rects AS (SELECT vec_id, vec_id // 200 AS doc_id, label AS page_index, least(e[1], e[2]) AS x0, least(e[3], e[4]) AS y0, greatest(e[1], e[2]) AS x1, greatest(e[3], e[4]) AS y1
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 4))"""


def sql_overlap(a: str, b: str) -> str:
    w, h = (f"(least({a}.{s}1, {b}.{s}1) - greatest({a}.{s}0, {b}.{s}0))" for s in "xy")
    area = lambda t: f"(greatest(0.0, {t}.x1 - {t}.x0) * greatest(0.0, {t}.y1 - {t}.y0))"
    return f"CASE WHEN {w} > 0 AND {h} > 0 AND least({area(a)}, {area(b)}) > 0 THEN {w} * {h} / least({area(a)}, {area(b)}) ELSE 0.0 END"


def q_rect_overlap(spark, d):
    r = rects(spark, d)
    a, b = r.select("doc_id", "page_index", F.col("vec_id").alias("a"), F.col("rect").alias("ra")), r.select("doc_id", "page_index", F.col("vec_id").alias("b"), F.col("rect").alias("rb"))
    ratio = geometry.overlap_ratio(F.col("ra"), F.col("rb"))
    return a.join(b, ["doc_id", "page_index"]).where("a < b").withColumn("ratio", ratio).where("ratio > 0").select("a", "b", F.round("ratio", 6).alias("ratio"))


def q_rect_valid(spark, d):
    odd = F.when(F.col("vec_id") % 11 == 0, F.slice("rect", 1, 3)).when(F.col("vec_id") % 11 == 1, F.array(F.col("rect")[2], F.col("rect")[1], F.col("rect")[0], F.col("rect")[3])).when(F.col("vec_id") % 11 == 2, F.array(F.col("rect")[0], F.lit(float("nan")), F.col("rect")[2], F.col("rect")[3])).otherwise(F.col("rect"))
    box = geometry.rect(-0.15, -0.15, 0.15, 0.15)
    return rects(spark, d).select("vec_id", geometry.rect_error(odd, box).alias("plan_error"), geometry.rect_error(odd, box, 0.05).alias("wide_error"))


_RECT_ERROR = "CASE WHEN vec_id % 11 = 0 THEN 'missing or malformed /Rect' WHEN vec_id % 11 = 2 THEN 'non-finite /Rect' WHEN vec_id % 11 = 1 AND x0 <= x1 THEN 'empty or reversed /Rect' WHEN x1 <= x0 OR y1 <= y0 THEN 'empty or reversed /Rect' WHEN x0 < -0.15 - {t} OR y0 < -0.15 - {t} OR x1 > 0.15 + {t} OR y1 > 0.15 + {t} THEN 'out-of-page /Rect' END"


def q_rects_equivalent(spark, d):
    moved = F.transform("rect", lambda x, i: x * 100 + F.when((F.col("vec_id") + i) % 4 == 0, 0.4 + (F.col("vec_id") % 3) * 0.1).otherwise(0.0))
    scaled = F.transform("rect", lambda x: x * 100)
    return rects(spark, d).select("vec_id", geometry.equivalent(scaled, moved).alias("same"), geometry.equivalent(scaled, F.slice(moved, 1, 3)).alias("short_same"))


def q_bundle_sha256(spark, d):
    docs = table(spark, d, "documents")
    path = F.format_string("%012d.txt", F.col("doc_id"))
    return docs.groupBy(F.expr("doc_id div 100").alias("bundle")).agg(F.count("*").alias("files"), digest.bundle_sha256(path, F.sha2("text", 256)).alias("bundle_sha256"))


def q_sha256_file(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def q_object_digest(spark, d):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("a"), F.col("n_regionkey").cast("string"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", digest.canonical_digest(m).alias("digest"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, length(n) AS n_chars_left, sha256(n) AS digest FROM (SELECT doc_id, {sql_norm('text')} AS n FROM documents)",
    "parse_page_label": f"WITH {TOKENS_SQL}, cores AS (SELECT token, n, {sql_label('token')} AS core FROM tokens) SELECT token, n, {sql_number('core')} AS number, CASE WHEN regexp_matches(core, '^[0-9]') THEN 'arabic' ELSE 'roman' END AS kind FROM cores WHERE core <> '' AND {sql_number('core')} IS NOT NULL",
    "roman_to_int": f"WITH {TOKENS_SQL} SELECT token, {sql_roman('token')} AS value FROM tokens WHERE regexp_matches(token, '^[ivxlcdmIVXLCDM]{{1,10}}$')",
    "int_to_roman": "SELECT o_orderkey, numeral, CASE WHEN numeral <> '' THEN n END AS back FROM (SELECT o_orderkey, CAST(o_orderkey % 4100 AS INTEGER) AS n, CASE WHEN o_orderkey % 4100 BETWEEN 1 AND 3999 THEN " + " || ".join(f"{sql_list(digits)}[CAST((o_orderkey % 4100) // {place} % 10 + 1 AS INTEGER)]" for place, digits in text.ROMAN.items()) + " ELSE '' END AS numeral FROM orders)",
    "ordinal_token": rf"WITH {TOKENS_SQL} SELECT token, n FROM tokens WHERE regexp_matches(token, '^([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,10}})[.·):\-]+$')",
    "roman_like": f"WITH {TOKENS_SQL} SELECT token, n FROM tokens WHERE length(regexp_replace(token, '[^A-Za-z]', '', 'g')) BETWEEN 1 AND 6 AND length(regexp_replace(token, '[^IVXLCDMivxlcdm]', '', 'g')) >= length(regexp_replace(token, '[^A-Za-z]', '', 'g')) - 1",
    "toc_title_clean": rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
dotted AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line || CASE WHEN line_no % 3 = 0 THEN ' .....' WHEN line_no % 3 = 1 THEN ' .. •• ' ELSE ' - ' END AS line FROM lines)
SELECT doc_id, line_no, sha256(trim(regexp_replace(line, '(?:\s*[.·•]{{2,}}\s*)+$', ''), ' .·•-–—' || chr(9))) AS digest FROM dotted""",
    "title_tokens": f"SELECT item_id, array_to_string(list_filter(string_split({sql_norm('text')}, ' '), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)), ' ') AS tokens FROM benchmark",
    "title_match_score": f"WITH {_TITLED_SQL} SELECT item_id, doc_id, round(score, 6) AS score FROM titled WHERE score > 0.4",
    "title_candidates": f"WITH {_TITLED_SQL} SELECT item_id, doc_id FROM titled WHERE exact",
    "title_unique": f"""WITH {_TITLED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS place, lead(score) OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS runner_up, count(*) FILTER (WHERE exact) OVER (PARTITION BY item_id) AS n_exact, max(CASE WHEN exact THEN doc_id END) OVER (PARTITION BY item_id) AS only_doc FROM titled)
SELECT item_id, CASE WHEN n_exact = 1 THEN only_doc WHEN score >= 0.85 AND (runner_up IS NULL OR score - runner_up >= 0.05) THEN doc_id END AS destination, round(CASE WHEN n_exact = 1 THEN 1.0 ELSE score END, 6) AS score FROM ranked WHERE place = 1""",
    "normalized_uri": f"WITH {TOKENS_SQL}, {_ADDRESSES}, vs AS (SELECT token, {_VALUE} AS v FROM addresses), us AS (SELECT token, {SQL_URI} AS uri, {SQL_URI_BARE} AS uri_bare FROM vs) SELECT * FROM us WHERE uri IS NOT NULL OR uri_bare IS NOT NULL",
    "supported_uri": f"WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN regexp_replace(url, '^https?://[^/]*', 'http://') WHEN 2 THEN 'mailto:a' || CASE WHEN page_id % 2 = 0 THEN '@' ELSE '?@' END || 'b.org' ELSE url END AS uri FROM pages) SELECT page_id, uri, {SQL_SUPPORTED.format(u='uri')} AS supported FROM u",
    "repo_url": "SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 2) THEN 'https://github.com/own-' || (page_id % 7) || '/repo.' || page_id END AS repository FROM pages",
    "page_list": "SELECT n_nationkey, CASE WHEN n_regionkey = n_nationkey % 5 THEN '' || n_regionkey ELSE least(n_regionkey, n_nationkey % 5) || ' ' || greatest(n_regionkey, n_nationkey % 5) END AS pages FROM nation",
    "requirement_pin": "WITH pins AS (SELECT lower(regexp_replace(replace(p_brand, '#', '_.'), '[-_.]+', '-', 'g')) AS name, p_size || '.0' AS version FROM part WHERE p_size % 3 <> 2) SELECT name, count(DISTINCT version) AS versions, min(version) AS first_version, count(DISTINCT version) > 1 AS conflict FROM pins GROUP BY name",
    "rect_overlap": f"WITH {RECTS_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round({sql_overlap('a', 'b')}, 6) AS ratio FROM rects a JOIN rects b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.vec_id < b.vec_id WHERE {sql_overlap('a', 'b')} > 0",
    "rect_valid": f"WITH {RECTS_SQL} SELECT vec_id, {_RECT_ERROR.format(t=0.01)} AS plan_error, {_RECT_ERROR.format(t=0.05)} AS wide_error FROM rects",
    "rects_equivalent": f"WITH {RECTS_SQL} SELECT vec_id, " + " AND ".join(f"abs({c} * 100 - ({c} * 100 + CASE WHEN (vec_id + {i}) % 4 = 0 THEN 0.4 + (vec_id % 3) * 0.1 ELSE 0.0 END)) <= 0.5" for i, c in enumerate(("x0", "y0", "x1", "y1"))) + " AS same, false AS short_same FROM rects",
    "bundle_sha256": "SELECT doc_id // 100 AS bundle, count(*) AS files, sha256(string_agg(printf('%012d.txt', doc_id) || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS bundle_sha256 FROM documents GROUP BY 1",
    "sha256_file": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "object_digest": "SELECT n_nationkey, sha256('1:a' || n_regionkey || chr(10) || '3:key' || n_nationkey || chr(10) || '4:name' || n_name || chr(10)) AS digest FROM nation",
}
