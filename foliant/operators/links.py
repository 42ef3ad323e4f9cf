"""Link annotations and planned links: kinds, targets, overlaps, claims, replay.

``annotations``: doc_id, page_index, annot_seq, subtype, dest, action, rect, target_page, uri, contents.
``links``: doc_id, link_seq, kind, source_page, rect, target_page, uri, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.geometry import bands, flip, overlap_ratio, rect_error
from foliant.functions.uri import bare_domain, normalized_uri, supported_uri

KINDS = ["internal", "external", "other"]


def annotation_kind(dest: Column, action: Column) -> Column:
    return F.when(dest.isNotNull() | F.coalesce(action == "/GoTo", F.lit(False)), F.lit("internal")).when(action == "/URI", F.lit("external")).otherwise(F.lit("other"))


def link_annotations(annotations: DataFrame) -> DataFrame:
    """The link annotations with their kind."""
    return annotations.where(F.col("subtype") == "/Link").withColumn("kind", annotation_kind(F.col("dest"), F.col("action")))


def link_counts(links: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, internal, external, other): links of each kind, 0 where there are none."""
    return links.groupBy(by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def existing_rects(annotations: DataFrame) -> DataFrame:
    """(doc_id, page_index, rect) of internal and external links."""
    return link_annotations(annotations).where("kind <> 'other'").select("doc_id", "page_index", "rect")


def resolve_destinations(annotations: DataFrame, named: DataFrame, refs: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Target pages of destinations: by name, by page number within bounds, or by a reference to a page object.

    ``annotations`` hold dest_name, dest_page, dest_ref; ``named``: doc_id, name, page_index; ``refs``: doc_id, ref, page_index.
    """
    out = annotations.join(named.select("doc_id", F.col("name").alias("dest_name"), F.col("page_index").alias("__n")), ["doc_id", "dest_name"], "left")
    out = out.join(refs.select("doc_id", F.col("ref").alias("dest_ref"), F.col("page_index").alias("__r")), ["doc_id", "dest_ref"], "left").join(page_counts, "doc_id", "left")
    number = F.when((F.col("dest_page") >= 0) & (F.col("dest_page") < F.col("page_count")), F.col("dest_page"))
    return out.withColumn("target_page", F.coalesce("__n", number, "__r")).select(*annotations.columns, "target_page")


def visible_urls(words: DataFrame, pages: DataFrame, allow_bare_domains: bool = False) -> DataFrame:
    """External links for the words that are addresses; addresses are never joined across words."""
    found = words.withColumn("uri", normalized_uri(F.col("text"), allow_bare_domains)).where("uri is not null")
    found = found.join(pages.select("doc_id", "page_index", "height", "rotate"), ["doc_id", "page_index"])
    box = flip(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"), F.col("height"))
    return found.select("doc_id", "page_index", "word_seq", F.lit("external").alias("kind"), box.alias("rect"), "uri", F.col("text").alias("label"), (F.pmod("rotate", F.lit(360)) != 0).alias("rotated"))


def sheet_urls(facts: DataFrame, allow_bare_domains: bool = False) -> DataFrame:
    """``visible_urls`` from ``layout.sheet_facts``."""
    found = facts.select("doc_id", "page_index", "rotate", F.explode("urls").alias("w"))
    return found.select("doc_id", "page_index", "w.word_seq", F.lit("external").alias("kind"), "w.rect", normalized_uri(F.col("w.text"), allow_bare_domains).alias("uri"), F.col("w.text").alias("label"), (F.pmod("rotate", F.lit(360)) != 0).alias("rotated"))


def bare_domain_skips(words: DataFrame) -> DataFrame:
    """Per document, how many words are addresses only if bare domains are allowed."""
    return words.groupBy("doc_id").agg(F.count_if(bare_domain(F.col("text"))).alias("skipped_bare_domain_candidates"))


def recovered_uris(annotations: DataFrame, allow_bare_domains: bool = False) -> DataFrame:
    """External links for link annotations without a usable action whose contents are an address."""
    found = link_annotations(annotations).where("kind = 'other' and rect is not null")
    found = found.withColumn("found", normalized_uri(F.col("contents"), allow_bare_domains)).where("found is not null")
    return found.select("doc_id", "page_index", "annot_seq", F.lit("external").alias("kind"), "rect", F.col("found").alias("uri"), F.lit("recovered annotation metadata").alias("label"))


def greedy_claims(candidates: DataFrame, occupied: DataFrame | None = None, by: list[str] | tuple[str, ...] = ("doc_id", "page_index"), order: str = "seq", overlap: float = K.OVERLAP) -> DataFrame:
    """``candidates`` (by, order, rect) with ``claimed``: in order, each takes its rectangle unless one already there overlaps it.

    ``occupied`` (by, rect) is there from the start. A candidate that was refused blocks none after it, so this is an
    ordered fold over a page.
    """
    by = list(by)
    pages = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("seq"), "rect"))).alias("cs"))
    if occupied is not None:
        pages = pages.join(occupied.groupBy(*by).agg(F.collect_list("rect").alias("held")), by, "left")
        pages = pages.withColumn("held", F.coalesce("held", F.array().cast("array<array<double>>")))
    else:
        pages = pages.withColumn("held", F.array().cast("array<array<double>>"))
    start = F.struct(F.col("held").alias("held"), F.array().cast("array<boolean>").alias("got"))

    def step(acc, c):
        free = ~F.exists(acc["held"], lambda r: overlap_ratio(r, c["rect"]) >= overlap)
        return F.struct(F.when(free, F.concat(acc["held"], F.array(c["rect"]))).otherwise(acc["held"]).alias("held"), F.concat(acc["got"], F.array(free)).alias("got"))

    flags = pages.select(*by, F.explode(F.arrays_zip("cs", F.aggregate("cs", start, step, lambda acc: acc["got"]).alias("got"))).alias("z"))
    return flags.select(*by, F.col("z.cs.seq").alias(order), F.col("z.got").alias("claimed"))


def overlapping_links(links: DataFrame, existing: DataFrame, overlap: float = K.OVERLAP) -> DataFrame:
    """Pairs of a link and an existing one on its page whose rectangles overlap: the spatial join behind replay and coverage."""
    there = existing.select("doc_id", F.col("page_index").alias("source_page"), F.col("kind").alias("there_kind"), F.col("rect").alias("there_rect"), F.col("target_page").alias("there_target"), F.col("uri").alias("there_uri"))
    mine = links.withColumn("__bands", bands(F.col("rect")))
    there = there.withColumn("__there", bands(F.col("there_rect")))
    mine, there = mine.withColumn("__band", F.explode("__bands")), there.withColumn("__band", F.explode("__there"))
    first = F.greatest(F.col("__bands")[0], F.col("__there")[0])  # each pair once, in the first band that both touch
    met = mine.join(there, ["doc_id", "source_page", "__band"]).where((F.col("__band") == first) & (overlap_ratio(F.col("rect"), F.col("there_rect")) >= overlap))
    return met.drop("__band", "__bands", "__there")


def existing_targets(links: DataFrame, existing: DataFrame) -> DataFrame:
    """(doc_id, link_seq, targets): target pages of the internal links that overlap each link."""
    found = overlapping_links(links, existing.where("kind = 'internal' and target_page is not null"))
    return found.groupBy("doc_id", "link_seq").agg(F.sort_array(F.collect_set("there_target")).alias("targets"))


def replay_status(links: DataFrame, existing: DataFrame, overlap: float = K.OVERLAP) -> DataFrame:
    """``links`` with ``status``: covered by one equal link, in conflict with another or with one planned before, or to add.

    ``link_seq`` gives the order in which planned links claim their rectangles.
    """
    same = (F.col("kind") == F.col("there_kind")) & F.when(F.col("kind") == "internal", F.col("target_page").eqNullSafe(F.col("there_target"))).otherwise(F.col("uri").eqNullSafe(F.col("there_uri")))
    met = overlapping_links(links, existing, overlap).groupBy("doc_id", "link_seq").agg(F.count("*").alias("n"), F.bool_and(same).alias("same"))
    out = links.join(met, ["doc_id", "link_seq"], "left")
    new = out.where("n is null").select("doc_id", F.col("source_page").alias("page_index"), F.col("link_seq").alias("seq"), "rect")
    claims = greedy_claims(new, existing.where("kind <> 'other'").select("doc_id", "page_index", "rect"), overlap=overlap).select("doc_id", F.col("seq").alias("link_seq"), "claimed")
    out = out.join(claims, ["doc_id", "link_seq"], "left")
    status = F.when((F.col("n") == 1) & F.col("same"), "covered").when(F.col("n").isNotNull() | ~F.col("claimed"), "conflict").otherwise("add")
    return out.select(*links.columns, status.alias("status"))


def geometry_mismatch(left: DataFrame, right: DataFrame, tolerance: float = K.GEOMETRY_MATCH) -> DataFrame:
    """Pages (doc_id, page_index) that two versions don't share in size, crop box or rotation; both sides have
    mediabox, cropbox and rotate. Empty for versions of one layout."""
    size = lambda b: F.array(b[2] - b[0], b[3] - b[1])
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda x: x)
    a = left.select("doc_id", "page_index", *[F.col(c).alias(f"a_{c}") for c in ("mediabox", "cropbox", "rotate")])
    b = right.select("doc_id", "page_index", *[F.col(c).alias(f"b_{c}") for c in ("mediabox", "cropbox", "rotate")])
    both = a.join(b, ["doc_id", "page_index"], "full")
    alike = near(size(F.col("a_mediabox")), size(F.col("b_mediabox"))) & near(size(F.col("a_cropbox")), size(F.col("b_cropbox"))) & (F.pmod("a_rotate", F.lit(360)) == F.pmod("b_rotate", F.lit(360)))
    return both.where(~F.coalesce(alike, F.lit(False))).select("doc_id", "page_index")


def link_errors(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Faults of existing internal and external links, one at most for each: rectangle, then destination or address."""
    found = links.where("kind <> 'other'").join(pages.select("doc_id", "page_index", "mediabox"), ["doc_id", "page_index"])
    fault = F.coalesce(rect_error(F.col("rect"), F.col("mediabox")), F.when((F.col("kind") == "internal") & F.col("target_page").isNull(), F.lit("unresolved internal destination")).when((F.col("kind") == "external") & ~supported_uri(F.col("uri")), F.lit("invalid external URI")))
    return found.withColumn("error", fault).where("error is not null").select("doc_id", "page_index", "annot_seq", "error")
