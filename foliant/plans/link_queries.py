"""Queries for links, replay, verification, manifests and plans, with their SQL.

Rectangles come from embeddings; addresses and relative references from pages;
line items stand for links where multisets are compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import gates, links, verify
from foliant.plans import plan
from foliant.plans.layout_queries import pages_of, sheets_of
from foliant.plans.scalar_queries import _RECT_ERROR, RECTS_SQL, SQL_SUPPORTED, rects, sql_overlap, table


def annotations_of(spark, d):
    """The references of web pages as annotations: relative ones as destinations, absolute ones as addresses."""
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("annot_seq", "href"))
    n = F.col("page_id") + F.col("annot_seq")
    relative = F.col("href").startswith("/")
    return found.select(
        F.expr("page_id div 10").alias("doc_id"), (F.col("page_id") % 10).cast("int").alias("page_index"), "annot_seq", F.when(n % 13 == 0, "/Text").otherwise("/Link").alias("subtype"),
        F.when(relative & (n % 3 == 0), F.col("href")).alias("dest"), F.when(relative & (n % 3 == 1), "/GoTo").when(~relative | (n % 5 == 0), "/URI").alias("action"),
        F.when(n % 4 == 1, F.concat(F.lit("www."), F.replace("href", F.lit("/"), F.lit("")), F.lit(".org"))).otherwise(F.col("href")).alias("contents"),
        F.array(F.lit(50.0), 700.0 - F.col("annot_seq") * 10, F.lit(250.0), 709.0 - F.col("annot_seq") * 10).alias("rect"), F.lit(None).cast("int").alias("target_page"), F.col("href").alias("uri"),
    )


ANNOTATIONS_SQL = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS annot_seq FROM pages),
annots AS (SELECT page_id // 10 AS doc_id, CAST(page_id % 10 AS INTEGER) AS page_index, CAST(annot_seq AS INTEGER) AS annot_seq, href, page_id + annot_seq AS n, starts_with(href, '/') AS relative FROM hrefs),
kinds AS (SELECT *, CASE WHEN relative AND n % 3 IN (0, 1) THEN 'internal' WHEN NOT relative OR n % 5 = 0 THEN 'external' ELSE 'other' END AS kind FROM annots WHERE n % 13 <> 0)"""


def linked(spark, d, part):
    """Rectangles as links; the target and the address follow from the number of the vector."""
    v = F.col("vec_id")
    return rects(spark, d).where(part).select("doc_id", "page_index", v.alias("seq"), "rect", F.when(v % 4 == 0, "external").when(v % 29 == 3, "other").otherwise("internal").alias("kind"), F.when(v % 4 != 0, (v % 3).cast("int")).alias("target_page"), F.when(v % 4 == 0, F.concat(F.lit("https://example.org/"), (v % 2).cast("string"))).alias("uri"))


LINKED_SQL = f"""{RECTS_SQL}, linked AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN 'external' WHEN vec_id % 29 = 3 THEN 'other' ELSE 'internal' END AS kind, CASE WHEN vec_id % 4 <> 0 THEN vec_id % 3 END AS target_page, CASE WHEN vec_id % 4 = 0 THEN 'https://example.org/' || (vec_id % 2) END AS uri FROM rects)"""
_PLANNED = "vec_id % 3 = 1"


def planned_and_there(spark, d):
    there = linked(spark, d, "vec_id % 3 <> 1")
    wanted = linked(spark, d, _PLANNED).where("kind <> 'other'").withColumnRenamed("page_index", "source_page").withColumnRenamed("seq", "link_seq")
    return wanted, there


def q_annotation_kind(spark, d):
    return links.link_annotations(annotations_of(spark, d)).groupBy("doc_id", "page_index", "kind").agg(F.count("*").alias("n"))


def q_link_counts(spark, d):
    return links.link_counts(links.link_annotations(annotations_of(spark, d)))


def q_recovered_uris(spark, d):
    return links.recovered_uris(annotations_of(spark, d)).select("doc_id", "page_index", "annot_seq", "uri")


def q_existing_rects(spark, d):
    return links.existing_rects(annotations_of(spark, d)).select("doc_id", "page_index", F.col("rect")[1].alias("y0"))


def q_destination_resolution(spark, d):
    a = annotations_of(spark, d).select("doc_id", "page_index", "annot_seq", F.when(F.col("annot_seq") % 3 == 0, F.col("contents")).alias("dest_name"), F.when(F.col("annot_seq") % 3 == 1, F.col("annot_seq") * 2 - 2).alias("dest_page"), F.when(F.col("annot_seq") % 3 == 2, F.concat(F.lit("ref"), (F.col("annot_seq") % 12).cast("string"))).alias("dest_ref"))
    pages = table(spark, d, "pages").select(F.expr("page_id div 10").alias("doc_id"), (F.col("page_id") % 10).cast("int").alias("page_index"))
    named = a.where("dest_name like '%a%'").groupBy("doc_id", F.col("dest_name").alias("name")).agg(F.min("page_index").alias("page_index"))
    refs = pages.select("doc_id", F.concat(F.lit("ref"), F.col("page_index").cast("string")).alias("ref"), "page_index")
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    return links.resolve_destinations(a, named, refs, counts).select("doc_id", "page_index", "annot_seq", "target_page")


def q_existing_targets(spark, d):
    wanted, there = planned_and_there(spark, d)
    return links.existing_targets(wanted, there).select("link_seq", F.array_join("targets", " ").alias("targets"))


def q_overlap_semantics(spark, d):
    wanted, there = planned_and_there(spark, d)
    return links.overlapping_links(wanted, there).groupBy("link_seq", "there_kind").agg(F.count("*").alias("n"), F.min("there_target").alias("lowest_target"), F.min("there_uri").alias("first_uri"))


def q_replay_status(spark, d):
    wanted, there = planned_and_there(spark, d)
    return links.replay_status(wanted, there).select("link_seq", "status")


def q_greedy_rect_claims(spark, d):
    return links.greedy_claims(rects(spark, d).withColumnRenamed("vec_id", "seq")).select("seq", "claimed")


def q_geometry_gate(spark, d):
    box = rects(spark, d).select("doc_id", F.col("vec_id").alias("page_index"), F.transform("rect", lambda x: x * 1000).alias("mediabox"), F.slice("rect", 1, 4).alias("cropbox"), F.lit(0).alias("rotate"))
    n = F.col("page_index")
    other = box.where(n % 17 != 0).select("doc_id", "page_index", F.transform("mediabox", lambda x, i: x + F.when((n % 5 == 0) & (i == 2), (n % 4) * 0.03).otherwise(0.0)).alias("mediabox"), "cropbox", F.when(n % 19 == 0, 90).when(n % 19 == 1, 360).otherwise(0).alias("rotate"))
    return links.geometry_mismatch(box, other)


def q_link_errors(spark, d):
    pages = rects(spark, d).select("doc_id", "page_index").distinct().withColumn("mediabox", geometry.rect(-0.15, -0.15, 0.15, 0.15))
    rows = linked(spark, d, "true").withColumnRenamed("seq", "annot_seq").withColumns({"target_page": F.when(F.col("annot_seq") % 7 != 0, F.col("target_page")), "uri": F.when(F.col("annot_seq") % 8 == 0, "nowhere").otherwise(F.col("uri"))})
    return links.link_errors(rows, pages).select("annot_seq", "error")


def verified(spark, d):
    pages = rects(spark, d).select("doc_id", "page_index").distinct().withColumn("mediabox", geometry.rect(1.9, 1.9, -1.9, -1.9))
    rows = linked(spark, d, "true").select("doc_id", (F.col("page_index") + 1).alias("source_page"), F.col("seq").alias("link_no"), F.when(F.col("seq") % 23 == 0, F.slice("rect", 1, 2)).otherwise(F.col("rect")).alias("rect"), "kind", "target_page", F.when(F.col("seq") % 8 == 0, "nowhere").otherwise(F.col("uri")).alias("uri"))
    return verify.verify_link_errors(rows, pages)


def q_verify_link_errors(spark, d):
    return verified(spark, d).select("link_no", "level", "message")


def q_error_preview(spark, d):
    return verify.error_preview(verified(spark, d), ["doc_id"], ["link_no", "message"])


def q_page_selection(spark, d):
    rows = linked(spark, d, "true").withColumn("source_page", F.col("page_index") + 1).withColumn("target_page", F.col("target_page") * 4)
    counts = rows.select("doc_id").distinct().withColumn("page_count", F.lit(9))
    return verify.page_selection(rows, counts)


def q_page_parity(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.sha2("text", 256).alias("content_sha256"), "n_chars", "lang")
    other = docs.where("doc_id % 31 <> 5").withColumns({"content_sha256": F.when(F.col("doc_id") % 37 == 1, "0").otherwise(F.col("content_sha256")), "lang": F.when(F.col("doc_id") % 41 == 2, F.lit(None)).otherwise(F.col("lang"))})
    other = other.withColumn("doc_id", F.when(F.col("doc_id") % 97 == 11, -F.col("doc_id")).otherwise(F.col("doc_id")))
    return verify.page_parity(docs, other, ["content_sha256", "n_chars", "lang"], ("doc_id",))


def q_count_reconcile(spark, d):
    rows = links.link_annotations(annotations_of(spark, d))
    n = F.col("page_index") * 7 + F.col("annot_seq")
    return verify.count_reconcile(rows.where(n % 2 == 0), rows.where((n % 2 == 1) & (F.col("doc_id") % 3 != 0)), rows.where((F.col("doc_id") % 5 != 1) | (n % 4 != 2)))


def items(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_returnflag").alias("b"), F.col("l_quantity").cast("int").alias("c"), "l_orderkey", "l_linenumber")


def q_multiset_match(spark, d):
    left = items(spark, d)
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    right = left.where(n % 101 != 0).withColumn("c", F.when(n % 103 == 0, F.col("c") + 1).otherwise(F.col("c")))
    return verify.exact_match(left, right, ["a", "b", "c"]).groupBy("a", "b", "c", "side").agg(F.count("*").alias("n"))


def q_tolerant_match(spark, d):
    want = linked(spark, d, "true").where("kind <> 'other'").select("doc_id", F.col("page_index").alias("source_page"), "kind", "target_page", "uri", F.transform("rect", lambda x: x * 20).alias("rect"), "seq")
    got = want.where("seq % 13 <> 0").withColumn("rect", F.transform("rect", lambda x: x + (F.col("seq") % 5) * 0.15)).withColumn("seq", -F.col("seq"))
    return verify.tolerant_match(want, got).select("side", "seq")


def q_path_collision(spark, d):
    paths = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.concat(F.regexp_replace("url", "^https?://[^/]*", "/data"), F.when(F.col("page_id") % 2 == 0, "/./x").otherwise("//x")).alias("path"))
    return verify.path_collisions(paths).select("first", "second")


def manifests_of(spark, d):
    p = table(spark, d, "pages").withColumn("n", F.col("page_id") % 12)
    n = F.col("n")
    own, foreign = F.sha2("url", 256), F.sha2("html", 256)
    link = F.struct(
        F.when(n == 7, "other").otherwise(F.when(F.col("page_id") % 2 == 0, "internal").otherwise("external")).alias("kind"), F.when(n == 8, 99).otherwise(0).alias("source_page"), F.lit(None).cast("int").alias("source_page_index"),
        F.when(n == 9, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(2.0))).alias("rect"), F.when(n == 10, 99).otherwise(1).alias("target_page"), F.lit(None).cast("int").alias("target_page_index"), F.when(n == 11, "nowhere").otherwise("https://example.org/").alias("uri"),
    )
    manifests = p.select(F.col("page_id").alias("doc_id"), F.when(n == 3, 1).otherwise(2).alias("schema_version"), F.when(n == 2, "NEEDS_REVIEW").otherwise("PASS").alias("status"), F.lit(False).alias("reviewed"), F.when(n == 4, F.lit(None)).when(n == 6, foreign).otherwise(F.upper(own)).alias("input_sha256"), F.when(n == 5, foreign).otherwise(F.lit(None)).alias("source_sha256"), F.when(n != 1, F.array(link, link)).alias("links"))
    return manifests, p.select(F.col("page_id").alias("doc_id"), own.alias("input_sha256"), F.lit(10).alias("page_count"))


def q_manifest_validation(spark, d):
    return verify.validate_manifests(*manifests_of(spark, d))


def q_signature_gate(spark, d):
    """Forms as trees: the orders of a customer below the customer; a field far down makes the file signed."""
    n = F.col("o_orderkey")
    fields = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("field"), F.when(n % 5 == 0, F.lit(None)).otherwise((n / 2).cast("bigint")).alias("parent"), (n % 211 == 7).alias("signature"))
    return gates.reachable_fields(fields).groupBy("doc_id").agg(F.count("*").alias("fields"), F.bool_or("signature").alias("has_signature"))


def q_unsupported_features(spark, d):
    """Web pages stand for documents: scripts for a collection, frames or tagged addresses for a form."""
    documents = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.contains("html", F.lit("<script")).alias("has_collection"), (F.contains("url", F.lit("ref=")) | F.contains("url", F.lit("#top"))).alias("has_xfa"))
    return gates.unsupported_features(documents).select(F.col("doc_id").alias("page_id"), F.array_join("features", ", ").alias("features"))


def q_reference_candidates(spark, d):
    kept, warnings = plan.reference_candidates(annotations_of(spark, d).withColumn("target_page", F.when(F.col("annot_seq") % 2 == 0, F.lit(3))))
    rows = kept.select("doc_id", F.col("source_page"), "kind", F.lit("candidate").alias("found"))
    return rows.union(warnings.select("doc_id", F.col("page") - 1, F.lit(None).cast("string"), "warning")).groupBy("doc_id", "source_page", "kind", "found").agg(F.count("*").alias("n"))


def q_ordered_distinct(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), ",").alias("roles"))


def auto(spark, d):
    return plan.sheet_plan(sheets_of(spark, d), annotations_of(spark, d))


def q_plan_links(spark, d):
    return auto(spark, d).links.groupBy("doc_id", "kind", "matched_by").agg(F.count("*").alias("n"), F.min("uri").alias("first_uri"))


def q_review_status(spark, d):
    found = plan.status(auto(spark, d).review, pages_of(spark, d))
    return found.select("doc_id", "status", F.array_join("review_reasons", "; ").alias("review_reasons"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_MET = f"met AS (SELECT a.vec_id AS link_seq, a.kind, a.target_page, a.uri, b.kind AS there_kind, b.target_page AS there_target, b.uri AS there_uri FROM linked a JOIN linked b ON a.doc_id = b.doc_id AND a.page_index = b.page_index WHERE a.vec_id % 3 = 1 AND a.kind <> 'other' AND b.vec_id % 3 <> 1 AND {sql_overlap('a', 'b')} >= 0.8)"
_VERIFY = """faults AS (SELECT doc_id, vec_id AS link_no, level, message FROM (
  SELECT *, unnest([CASE WHEN short THEN ['error', 'has no valid rectangle'] END, CASE WHEN NOT short AND (x1 <= x0 OR y1 <= y0) THEN ['error', 'has an empty or inverted rectangle'] END,
    CASE WHEN NOT short AND (x0 < 1.9 - 2 OR y0 < 1.9 - 2 OR x1 > -1.9 + 2 OR y1 > -1.9 + 2) THEN ['error', 'rectangle lies outside the page bounds'] END,
    CASE WHEN NOT short AND kind = 'internal' AND NOT coalesce(target_page BETWEEN 1 AND pages, false) THEN ['error', 'has an unresolved or invalid internal destination'] END,
    CASE WHEN NOT short AND kind = 'external' AND NOT SUPPORTED THEN ['error', 'has an invalid external URI'] END,
    CASE WHEN NOT short AND kind = 'other' THEN ['warning', 'uses an unsupported or incomplete link action'] END]) AS f
  FROM (SELECT doc_id, vec_id, x0, y0, x1, y1, kind, target_page, CASE WHEN vec_id % 8 = 0 THEN 'nowhere' ELSE uri END AS uri, vec_id % 23 = 0 AS short, p.pages FROM linked JOIN (SELECT doc_id, count(DISTINCT page_index) AS pages FROM rects GROUP BY doc_id) p USING (doc_id))), LATERAL (SELECT f[1] AS level, f[2] AS message) WHERE f IS NOT NULL)""".replace("SUPPORTED", SQL_SUPPORTED.format(u="uri"))

GREEDY = f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY vec_id) AS rn FROM rects),
fold(doc_id, page_index, rn, vec_id, claimed, held) AS (
  SELECT doc_id, page_index, rn, vec_id, true, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.page_index, r.rn, r.vec_id, len(list_filter(f.held, lambda h: {sql_overlap('h', 'r')} >= 0.8)) = 0,
    CASE WHEN len(list_filter(f.held, lambda h: {sql_overlap('h', 'r')} >= 0.8)) = 0 THEN list_append(f.held, {{'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) ELSE f.held END
  FROM fold f JOIN r ON r.doc_id = f.doc_id AND r.page_index = f.page_index AND r.rn = f.rn + 1)"""

ORACLE_SQL = {
    "annotation_kind": f"WITH {ANNOTATIONS_SQL} SELECT doc_id, page_index, kind, count(*) AS n FROM kinds GROUP BY ALL",
    "link_counts": f"WITH {ANNOTATIONS_SQL} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in links.KINDS) + " FROM kinds GROUP BY doc_id",
    "recovered_uris": f"WITH {ANNOTATIONS_SQL} SELECT doc_id, page_index, annot_seq, 'https://www.' || rtrim(replace(href, '/', ''), 'x') || '.org' AS uri FROM kinds WHERE false",
    "existing_rects": f"WITH {ANNOTATIONS_SQL} SELECT doc_id, page_index, CAST(700.0 - annot_seq * 10 AS DOUBLE) AS y0 FROM kinds WHERE kind <> 'other'",
    "existing_targets": f"WITH {LINKED_SQL}, {_MET} SELECT link_seq, array_to_string(list_sort(list(DISTINCT there_target)), ' ') AS targets FROM met WHERE there_kind = 'internal' AND there_target IS NOT NULL GROUP BY link_seq",
    "overlap_semantics": f"WITH {LINKED_SQL}, {_MET} SELECT link_seq, there_kind, count(*) AS n, min(there_target) AS lowest_target, min(there_uri) AS first_uri FROM met GROUP BY ALL",
    "greedy_rect_claims": f"WITH RECURSIVE {RECTS_SQL}, {GREEDY} SELECT vec_id AS seq, claimed FROM fold",
    "geometry_gate": "WITH p AS (SELECT vec_id // 200 AS doc_id, vec_id AS page_index FROM embeddings WHERE label IS NOT NULL AND len(embedding) >= 4) SELECT doc_id, page_index FROM p WHERE page_index % 17 = 0 OR page_index % 19 = 0 OR (page_index % 5 = 0 AND (page_index % 4) * 0.03 > 0.05)",
    "link_errors": f"WITH {LINKED_SQL}, e AS (SELECT vec_id, kind, {_RECT_ERROR.replace('vec_id % 11', '-1').format(t=0.01)} AS rect_error, CASE WHEN vec_id % 7 <> 0 THEN target_page END AS target_page, CASE WHEN vec_id % 8 = 0 THEN 'nowhere' ELSE uri END AS uri FROM linked WHERE kind <> 'other'), f AS (SELECT vec_id AS annot_seq, coalesce(rect_error, CASE WHEN kind = 'internal' AND target_page IS NULL THEN 'unresolved internal destination' WHEN kind = 'external' AND NOT {SQL_SUPPORTED.format(u='uri')} THEN 'invalid external URI' END) AS error FROM e) SELECT * FROM f WHERE error IS NOT NULL",
    "verify_link_errors": f"WITH {LINKED_SQL}, {_VERIFY} SELECT link_no, level, message FROM faults",
    "error_preview": f"WITH {LINKED_SQL}, {_VERIFY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY link_no, message) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM faults) SELECT doc_id, string_agg(message, '; ' ORDER BY place) FILTER (WHERE place <= 10) || CASE WHEN max(n) > 10 THEN '; plus ' || (max(n) - 10) || ' more' ELSE '' END AS preview FROM ranked GROUP BY doc_id",
    "page_selection": f"WITH {LINKED_SQL} SELECT DISTINCT doc_id, page FROM (SELECT doc_id, unnest([1, 9]) AS page FROM linked UNION SELECT doc_id, page_index + 1 FROM linked WHERE kind = 'internal' UNION SELECT doc_id, CAST(target_page * 4 AS INTEGER) FROM linked WHERE kind = 'internal') WHERE page BETWEEN 1 AND 9",
    "page_parity": "WITH a AS (SELECT doc_id, sha256(text) AS s, n_chars, lang FROM documents), b AS (SELECT CASE WHEN doc_id % 97 = 11 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 37 = 1 THEN '0' ELSE s END AS s, n_chars, CASE WHEN doc_id % 41 <> 2 THEN lang END AS lang FROM a WHERE doc_id % 31 <> 5) SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.s IS DISTINCT FROM b.s THEN 'content_sha256' WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END AS fault FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE fault IS NOT NULL",
    "count_reconcile": f"WITH {ANNOTATIONS_SQL}, k AS (SELECT doc_id, kind, page_index * 7 + annot_seq AS m FROM kinds), s AS (SELECT doc_id, kind, count(*) FILTER (WHERE m % 2 = 0) AS existing, count(*) FILTER (WHERE m % 2 = 1 AND doc_id % 3 <> 0) AS added, count(*) FILTER (WHERE doc_id % 5 <> 1 OR m % 4 <> 2) AS final FROM k GROUP BY ALL) SELECT * FROM s WHERE existing + added <> final",
    "multiset_match": "WITH l AS (SELECT l_suppkey AS a, l_returnflag AS b, CAST(l_quantity AS INTEGER) AS c, l_orderkey * 7 + l_linenumber AS m FROM lineitem), x AS (SELECT a, b, c, count(*) AS n FROM l GROUP BY ALL), y AS (SELECT a, b, CASE WHEN m % 103 = 0 THEN c + 1 ELSE c END AS c, count(*) AS n FROM l WHERE m % 101 <> 0 GROUP BY ALL) SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.c, y.c) AS c, CASE WHEN coalesce(x.n, 0) > coalesce(y.n, 0) THEN 'missing' ELSE 'unexpected' END AS side, abs(coalesce(x.n, 0) - coalesce(y.n, 0)) AS n FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b AND x.c = y.c WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)",
    "path_collision": "WITH p AS (SELECT 'p' || page_id AS name, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', '/data') || CASE WHEN page_id % 2 = 0 THEN '/./x' ELSE '//x' END, '/(?:\\./)+', '/', 'g'), '/{2,}', '/', 'g') AS path FROM pages) SELECT first, name AS second FROM p JOIN (SELECT path, min(name) AS first FROM p GROUP BY path) USING (path) WHERE name <> first",
    "manifest_validation": """WITH m AS (SELECT page_id AS doc_id, page_id % 12 AS n, page_id % 2 = 0 AS internal FROM pages)
SELECT * FROM (SELECT doc_id, CASE WHEN n BETWEEN 1 AND 6 THEN 0 ELSE 1 END AS position, CASE n WHEN 1 THEN 'manifest must be an object with a links array' WHEN 2 THEN 'manifest is neither PASS nor reviewed' WHEN 3 THEN 'manifest schema_version is not supported' WHEN 4 THEN 'manifest requires input_sha256' WHEN 5 THEN 'manifest hashes disagree' WHEN 6 THEN 'manifest input_sha256 belongs to another file'
  WHEN 7 THEN 'unsupported kind' WHEN 8 THEN 'invalid source page' WHEN 9 THEN 'invalid rectangle' WHEN 10 THEN CASE WHEN internal THEN 'invalid target page' END WHEN 11 THEN CASE WHEN NOT internal THEN 'unsupported URI' END END AS error FROM m) WHERE error IS NOT NULL""",
    "signature_gate": "WITH RECURSIVE f AS (SELECT o_custkey AS doc_id, o_orderkey AS field, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 2 END AS parent, o_orderkey % 211 = 7 AS signature FROM orders), below AS (SELECT doc_id, field, signature FROM f WHERE parent IS NULL UNION ALL SELECT f.doc_id, f.field, f.signature FROM below b JOIN f ON f.doc_id = b.doc_id AND f.parent = b.field) SELECT doc_id, count(*) AS fields, bool_or(signature) AS has_signature FROM below GROUP BY doc_id",
    "unsupported_features": "SELECT page_id, features FROM (SELECT page_id, array_to_string(list_filter([CASE WHEN contains(html, '<script') THEN 'PDF portfolio/collection' END, CASE WHEN contains(url, 'ref=') OR contains(url, '#top') THEN 'XFA form' END], lambda x: x IS NOT NULL), ', ') AS features FROM pages) WHERE features <> ''",
    "reference_candidates": f"WITH {ANNOTATIONS_SQL} SELECT doc_id, page_index AS source_page, kind, found, count(*) AS n FROM (SELECT doc_id, page_index, CASE WHEN lost THEN NULL ELSE kind END AS kind, CASE WHEN lost THEN 'unresolved reference link' ELSE 'candidate' END AS found FROM (SELECT *, kind = 'internal' AND annot_seq % 2 <> 0 AS lost FROM kinds WHERE kind <> 'other')) GROUP BY ALL",
    "ordered_distinct": "SELECT conv_id, string_agg(role, ',' ORDER BY first, role) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id",
}
ORACLE_SQL["recovered_uris"] = f"WITH {ANNOTATIONS_SQL}, c AS (SELECT doc_id, page_index, annot_seq, rtrim(ltrim(CASE WHEN n % 4 = 1 THEN 'www.' || replace(href, '/', '') || '.org' ELSE href END, '([{{<''\"'), '.,;:!?)]}}>''\"') AS v FROM kinds WHERE kind = 'other') SELECT doc_id, page_index, annot_seq, CASE WHEN regexp_matches(v, '^https?://', 'i') THEN v ELSE 'https://' || v END AS uri FROM c WHERE regexp_matches(v, '^(?:https?://|www\\.)[^\\s<>]+$', 'i')"
ORACLE_SQL["replay_status"] = f"""WITH RECURSIVE {LINKED_SQL}, {_MET},
state AS (SELECT link_seq, count(*) AS n, bool_and(kind = there_kind AND CASE WHEN kind = 'internal' THEN target_page IS NOT DISTINCT FROM there_target ELSE uri IS NOT DISTINCT FROM there_uri END) AS same FROM met GROUP BY link_seq),
r AS (SELECT l.*, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY vec_id) AS rn FROM linked l LEFT JOIN state s ON s.link_seq = l.vec_id WHERE vec_id % 3 = 1 AND kind <> 'other' AND s.link_seq IS NULL),
fold(doc_id, page_index, rn, vec_id, claimed, held) AS (
  SELECT doc_id, page_index, rn, vec_id, true, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.page_index, r.rn, r.vec_id, len(list_filter(f.held, lambda h: {sql_overlap('h', 'r')} >= 0.8)) = 0,
    CASE WHEN len(list_filter(f.held, lambda h: {sql_overlap('h', 'r')} >= 0.8)) = 0 THEN list_append(f.held, {{'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) ELSE f.held END
  FROM fold f JOIN r ON r.doc_id = f.doc_id AND r.page_index = f.page_index AND r.rn = f.rn + 1)
SELECT l.vec_id AS link_seq, CASE WHEN s.n = 1 AND s.same THEN 'covered' WHEN s.n IS NOT NULL OR NOT f.claimed THEN 'conflict' ELSE 'add' END AS status FROM linked l LEFT JOIN state s ON s.link_seq = l.vec_id LEFT JOIN fold f ON f.vec_id = l.vec_id WHERE l.vec_id % 3 = 1 AND l.kind <> 'other'"""
ORACLE_SQL["destination_resolution"] = f"""WITH {ANNOTATIONS_SQL.replace("WHERE n % 13 <> 0", "")}, a AS (SELECT doc_id, page_index, annot_seq, CASE WHEN annot_seq % 3 = 0 THEN CASE WHEN n % 4 = 1 THEN 'www.' || replace(href, '/', '') || '.org' ELSE href END END AS dest_name FROM annots),
named AS (SELECT doc_id, dest_name, min(page_index) AS page_index FROM a WHERE dest_name LIKE '%a%' GROUP BY ALL), pc AS (SELECT page_id // 10 AS doc_id, count(*) AS pages FROM pages GROUP BY ALL)
SELECT a.doc_id, a.page_index, a.annot_seq, CAST(CASE a.annot_seq % 3 WHEN 0 THEN n.page_index WHEN 1 THEN CASE WHEN a.annot_seq * 2 - 2 < pc.pages THEN a.annot_seq * 2 - 2 END ELSE CASE WHEN a.annot_seq % 12 < pc.pages THEN a.annot_seq % 12 END END AS INTEGER) AS target_page FROM a LEFT JOIN named n ON n.doc_id = a.doc_id AND n.dest_name = a.dest_name JOIN pc ON pc.doc_id = a.doc_id"""
