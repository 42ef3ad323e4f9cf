"""Plan assembly: from words, pages and existing annotations to links, unresolved rows and reasons for review."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.uri import supported_uri
from foliant.operators import layout, links, pagination, resolve
from foliant.plans.materialize import cut

LINK = ["doc_id", "kind", "source_page", "rect", "target_page", "uri", "label", "title", "printed_label", "printed_number", "label_kind", "matched_by", "confidence", "evidence"]

#: Ids of documents that are sent to all executors at most.
SENT = 100_000

CONFLICT = "replayed links overlap links with other destinations"


@dataclass(frozen=True)
class Options:
    toc_links: bool = True
    url_links: bool = True
    allow_bare_domains: bool = False
    page_offset: int | None = None


@dataclass(frozen=True)
class Plan:
    links: DataFrame
    unresolved: DataFrame
    segments: DataFrame
    completeness: DataFrame
    skipped_bare_domains: DataFrame
    review: DataFrame
    covered: DataFrame


def _review(reasons: list[tuple[DataFrame, str]]) -> DataFrame:
    rows = [d.select("doc_id", F.lit(text).alias("reason")) for d, text in reasons]
    return reduce(DataFrame.union, rows).distinct()


def _as_links(rows: DataFrame, **given: Column) -> DataFrame:
    kinds = {"target_page": "int", "printed_number": "int", "rect": "array<double>"}
    value = lambda c: given[c] if c in given else F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string"))
    return rows.select(*[value(c).alias(c) for c in LINK], F.col("__seq"))


def _few(ids: DataFrame) -> DataFrame:
    """Ids, sent to all executors where they are few, so that the other side of a join isn't exchanged."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= SENT else ids


def automatic_plan(words: DataFrame, pages: DataFrame, annotations: DataFrame, options: Options = Options(), toc_pages: DataFrame | None = None) -> Plan:
    """Contents rows become internal links, addresses external ones; whatever is ambiguous asks for review.

    ``toc_pages`` (doc_id, page_index) replaces detection.
    """
    return replace(sheet_plan(layout.sheets(words, pages), annotations, options, toc_pages), skipped_bare_domains=links.bare_domain_skips(words))


def sheet_plan(sheets: DataFrame, annotations: DataFrame, options: Options = Options(), toc_pages: DataFrame | None = None) -> Plan:
    """The plan of pages that hold their words (``layout.sheets``, ``relations.text_sheets``).

    ``sheets`` should be read from a table. Words stay on their pages: each sheet is reduced in place to its few contents
    rows, labels, counts and addresses, which are written once to the checkpoint folder. Only documents with contents
    pages have their text written too, since titles are searched there.
    """
    facts = cut(layout.sheet_facts(sheets, options.allow_bare_domains))
    pages = facts.select("doc_id", "page_index", "rotate")
    rows = facts.where("doc_id is not null").select("doc_id", "page_index", F.explode("rows").alias("r")).select("doc_id", "page_index", "r.*")
    labels = layout.sheet_labels(facts)
    contents = cut(pagination.detect_toc_pages(facts.drop("seed"), toc_pages if toc_pages is not None else facts.where("seed").select("doc_id", "page_index"), toc_pages is not None))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    blocks = cut(pagination.contents_blocks(contents, counts))
    placed = rows.join(blocks.select("doc_id", "block_index", "start_page", "end_page"), "doc_id").where("page_index between start_page and end_page").drop("start_page", "end_page")
    segments = pagination.pagination_segments(labels, blocks)
    if options.page_offset is not None:
        segments = pagination.manual_offset_segments(placed, options.page_offset)
    segments = cut(segments)
    completeness = layout.toc_completeness(facts, contents)
    rotated = pages.where(F.pmod("rotate", F.lit(360)) != 0).select("doc_id", "page_index")
    existing = links.link_annotations(annotations)
    held = existing.where("kind <> 'other'").select("doc_id", "page_index", "rect")

    texts = cut(layout.sheet_text(sheets.join(_few(blocks.select("doc_id").distinct()), "doc_id", "left_semi")))
    found = cut(resolve.resolve_rows(placed, segments, labels, texts, blocks, contents))
    usable = F.col("target_page").isNotNull() & (F.col("target_page") != F.col("page_index"))
    keyed = found.withColumn("link_seq", F.struct("page_index", "line_no")).withColumn("source_page", F.col("page_index"))
    there = links.overlapping_links(keyed.where(usable).select("doc_id", "link_seq", "source_page", "rect", "target_page"), existing.where("kind <> 'other'"))
    met = there.groupBy("doc_id", "link_seq").agg(F.bool_or((F.col("there_kind") == "internal") & (F.col("there_target") == F.col("target_page"))).alias("agrees"), F.bool_and((F.col("there_kind") == "internal") & (F.col("there_target") == F.col("target_page"))).alias("all_agree"))
    judged = cut(keyed.join(met, ["doc_id", "link_seq"], "left"))
    covered = judged.where(usable & F.col("all_agree"))
    blocked = judged.where(usable & F.col("agrees").isNotNull() & ~F.col("all_agree"))
    open_rows = judged.where(usable & F.col("agrees").isNull())

    toc_links = _as_links(open_rows.withColumn("__seq", F.struct(F.lit(0).alias("part"), F.col("page_index").alias("a"), F.col("line_no").alias("b"))), kind=F.lit("internal"), label=F.col("title"))
    urls = links.sheet_urls(facts, options.allow_bare_domains)
    url_links = _as_links(urls.where("not rotated").withColumn("__seq", F.struct(F.lit(1).alias("part"), F.col("page_index").alias("a"), F.col("word_seq").alias("b"))), source_page=F.col("page_index"), matched_by=F.lit("visible-url"), confidence=F.lit("high"))
    back = links.recovered_uris(annotations, options.allow_bare_domains)
    back_links = _as_links(back.withColumn("__seq", F.struct(F.lit(2).alias("part"), F.col("page_index").alias("a"), F.col("annot_seq").alias("b"))), source_page=F.col("page_index"), matched_by=F.lit("recovered-annotation"), confidence=F.lit("high"))
    parts = ([toc_links] if options.toc_links else []) + ([url_links, back_links] if options.url_links else [])
    wanted = reduce(DataFrame.union, parts) if parts else toc_links.where("false")
    claims = links.greedy_claims(wanted.select("doc_id", F.col("source_page").alias("page_index"), F.col("__seq").alias("seq"), "rect"), held)
    claimed = cut(wanted.join(claims.select("doc_id", F.col("seq").alias("__seq"), "claimed"), ["doc_id", "__seq"]))
    planned = claimed.where("claimed").select(*LINK)

    row = ["doc_id", F.col("page_index").alias("source_page"), "line_no", "title", "printed_label"]
    refused = claimed.where("not claimed and kind = 'internal'").select("doc_id", F.col("source_page"), F.col("__seq.b").alias("line_no"), "title", "printed_label", F.lit("overlaps another planned link").alias("reason"))
    no_target = judged.where(~F.coalesce(usable, F.lit(False))).select(*row, F.coalesce("reason", F.lit("target is the contents page itself")).alias("reason"))
    unresolved = no_target.union(blocked.select(*row, F.lit("overlaps an existing link with another target"))).union(refused)
    if not options.toc_links:
        unresolved = unresolved.where("false")

    text = facts.groupBy("doc_id").agg(F.bool_or("has_text").alias("any")).where("not any")
    all_docs = pages.select("doc_id").distinct()
    reasons = [
        (rotated.join(contents, ["doc_id", "page_index"]), "rotated contents pages need review"),
        (text, "no extractable text"),
        (completeness.groupBy("doc_id").agg(F.sum("suspected_unparsed_rows").alias("n")).where("n > 0"), "suspected unparsed contents rows"),
        (planned.where("kind = 'external'").where(~supported_uri(F.col("uri"))), "unsupported addresses"),
        (unresolved, "unresolved contents rows"),
        (all_docs.join(planned.select("doc_id").union(covered.select("doc_id")).distinct(), "doc_id", "left_anti"), "nothing to link"),
    ]
    if options.url_links:
        reasons.append((urls.where("rotated"), "addresses on rotated pages"))
    return Plan(planned, unresolved, segments, completeness, links.bare_domain_skips(layout.words_on(sheets)), _review(reasons), covered)


def replay_plan(manifest_links: DataFrame, annotations: DataFrame, toc_links: bool = True, url_links: bool = True) -> DataFrame:
    """Links of a reviewed manifest or of a version of the same layout, with status add, covered or conflict."""
    kept = manifest_links.where(F.lit(toc_links) | (F.col("kind") != "internal")).where(F.lit(url_links) | (F.col("kind") != "external"))
    return links.replay_status(kept, links.link_annotations(annotations))


def reference_candidates(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, warnings) of a version of the same layout, its destinations resolved.

    Candidates: doc_id, link_seq, kind, source_page, rect, target_page, uri, label. Warnings: doc_id, page, warning, for
    links whose destination or address isn't there.
    """
    found = links.link_annotations(annotations).where("kind <> 'other' and rect is not null")
    lost = F.when((F.col("kind") == "internal") & F.col("target_page").isNull(), "unresolved reference link").when((F.col("kind") == "external") & F.col("uri").isNull(), "unresolved reference address")
    found = found.withColumn("warning", lost)
    inner = F.col("kind") == "internal"
    kept = found.where("warning is null").select("doc_id", F.struct("page_index", "annot_seq").alias("link_seq"), "kind", F.col("page_index").alias("source_page"), "rect", F.when(inner, F.col("target_page")).alias("target_page"), F.when(~inner, F.col("uri")).alias("uri"), F.lit("copied from reference").alias("label"))
    return kept, found.where("warning is not null").select("doc_id", (F.col("page_index") + 1).alias("page"), "warning")


def reference_plan(reference: DataFrame, reference_pages: DataFrame, annotations: DataFrame, pages: DataFrame, toc_links: bool = True, url_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links with status, review): the links of a version of the same layout, put on documents that lack them.

    ``reference`` and ``annotations``: annotations with resolved target pages; both pages with mediabox, cropbox and
    rotate. Documents whose layout differs from the reference get no link, and the review says so.
    """
    odd = cut(links.geometry_mismatch(reference_pages, pages).select("doc_id").distinct())
    kept, warnings = reference_candidates(reference.join(odd, "doc_id", "left_anti"))
    planned = cut(replay_plan(kept, annotations, toc_links, url_links))
    review = _review([(odd, "layout differs from the reference"), (warnings, "unresolvable reference links"), (planned.where("status = 'conflict'"), CONFLICT)])
    return planned, review


def replay_review(planned: DataFrame) -> DataFrame:
    """(doc_id, reason): documents where a link to replay meets another one; ``planned`` as ``replay_plan`` makes it."""
    return _review([(planned.where("status = 'conflict'"), CONFLICT)])


def status(review: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, status, review_reasons): PASS without reasons, else NEEDS_REVIEW."""
    why = review.groupBy("doc_id").agg(F.sort_array(F.collect_set("reason")).alias("review_reasons"))
    out = documents.select("doc_id").distinct().join(why, "doc_id", "left").withColumn("review_reasons", F.coalesce("review_reasons", F.array().cast("array<string>")))
    return out.select("doc_id", F.when(F.size("review_reasons") > 0, "NEEDS_REVIEW").otherwise("PASS").alias("status"), "review_reasons")


def report(plan: Plan, documents: DataFrame) -> DataFrame:
    """One row a document: status, counts, segments and links, ready for ``to_json`` or ``write.json``."""
    by_doc = lambda rows, name: rows.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias(name))
    added = links.link_counts(plan.links).select("doc_id", F.struct(*links.KINDS).alias("added_links"))
    out = status(plan.review, documents).withColumn("schema_version", F.lit(2))
    for part in (added, by_doc(plan.segments, "pagination_segments"), by_doc(plan.completeness, "toc_completeness"), by_doc(plan.unresolved, "unresolved_toc_rows"), plan.skipped_bare_domains, pagination.single_offset(plan.segments), by_doc(plan.links, "links")):
        out = out.join(part, "doc_id", "left")
    return out
