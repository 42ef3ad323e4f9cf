"""Contents rows to target pages: by pagination segments, else by a unique title; anything ambiguous stays unresolved.

``rows``: doc_id, block_index, page_index, line_no, title, printed_number, label_kind.
``labels``: doc_id, page_index, printed_number, label_kind. ``pages``: doc_id, page_index, normalized_text.
``segments`` as made by ``pagination_segments``. A document's rows, segments and pages meet on its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.text import normalize_text, title_match_score, title_tokens
from foliant.plans.materialize import cut

ROW = ["doc_id", "page_index", "line_no"]


def trusted_labels(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, block_index, label_kind, page_index, observed): the labels of a page that lie on an offset of a block's segments."""
    offsets = segments.select("doc_id", "block_index", "label_kind", "offset").distinct()
    seen = labels.withColumn("offset", F.col("page_index") + 1 - F.col("printed_number"))
    return seen.join(offsets, ["doc_id", "label_kind", "offset"]).groupBy("doc_id", "block_index", "label_kind", "page_index").agg(F.sort_array(F.collect_set("printed_number")).alias("observed"))


def segment_candidates(rows: DataFrame, segments: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Each row with the segments of its block and kind that reach its number, give or take a few, and the page they lead to."""
    parts = segments.select("doc_id", "block_index", "label_kind", "printed_start", "printed_end", "offset", "evidence_pages")
    near = F.col("printed_number").between(F.col("printed_start") - K.SEGMENT_SLACK, F.col("printed_end") + K.SEGMENT_SLACK)
    found = rows.join(parts, ["doc_id", "block_index", "label_kind"]).where(near).join(page_counts, "doc_id")
    found = found.withColumn("destination", F.col("printed_number") + F.col("offset") - 1)
    return found.where((F.col("destination") >= 0) & (F.col("destination") < F.col("page_count"))).drop("page_count")


def titles_on_pages(titles: DataFrame, pages: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """(key, candidate, score, exact): how well normalised titles (key, by, plain) fit normalised pages (by, candidate, normalized_text).

    Titles and pages meet on ``by`` and on a word, so pairs without a common word are
    never formed; they'd score 0 and are left out. A page that holds a title holds the
    words inside it whole (its first and last may be parts of longer ones), so only
    pages that hold all of them are searched. Titles of one or two words have no such
    words: a page is searched for all of those of its ``by`` in place.
    """
    words = F.split("plain", " ")
    tokens = title_tokens(F.col("plain"))
    inner = F.array_distinct(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    scored = (F.length("plain") >= K.TITLE_CHARS) & (F.size(tokens) >= K.TITLE_TOKENS)
    known = cut(titles.select(*key, *by, "plain", F.array_distinct(tokens).alias("tokens"), scored.alias("scored"), inner.alias("inner")))
    each = known.select(*key, *by, "scored", F.size("tokens").alias("n_tokens"), F.size("inner").alias("n_inner"), "tokens", "inner", F.explode(F.array_union(F.when(F.col("scored"), F.col("tokens")).otherwise(F.array().cast("array<string>")), F.col("inner"))).alias("word"))
    each = each.select(*key, *by, "word", "n_tokens", "n_inner", (F.col("scored") & F.array_contains("tokens", F.col("word"))).alias("token"), F.array_contains("inner", F.col("word")).alias("within"))
    on_page = pages.select(*by, "candidate", F.explode(F.array_distinct(F.split("normalized_text", " "))).alias("word"))
    vocabulary = each.select(*by, "word").distinct()
    met = on_page.join(vocabulary, [*by, "word"], "left_semi").join(each, [*by, "word"])
    shared = cut(met.groupBy(*key, *by, "candidate").agg(F.count_if("token").alias("hits"), F.count_if("within").alias("found"), F.first("n_tokens").alias("n_tokens"), F.first("n_inner").alias("n_inner")))
    whole = shared.where("found = n_inner and n_inner > 0").join(known.select(*key, *by, "plain"), [*key, *by]).join(pages.select(*by, "candidate", "normalized_text"), [*by, "candidate"])
    whole = whole.where(F.contains("normalized_text", F.col("plain"))).select(*key, *by, "candidate")
    short = known.where(F.size("inner") == 0).groupBy(*by).agg(F.collect_list(F.struct(*key, "plain")).alias("short"))
    beside = pages.join(short, by) if by else pages.crossJoin(F.broadcast(short))  # one row, of the titles of one or two words
    held = F.filter("short", lambda t: F.contains(F.col("normalized_text"), t["plain"]))
    in_place = beside.select(*by, "candidate", F.explode(held).alias("t")).select(*[F.col("t")[k].alias(k) for k in key], *by, "candidate")
    exact = whole.unionByName(in_place).distinct().join(known.select(*key, *by, (F.length("plain") >= K.TITLE_CHARS).alias("exact_score")), [*key, *by])
    both = shared.select(*key, *by, "candidate", F.when(F.col("n_tokens") > 0, F.col("hits") / F.col("n_tokens")).alias("share")).join(exact, [*key, *by, "candidate"], "full")
    score = F.when(F.col("exact_score"), F.lit(1.0)).when(~F.col("exact_score"), F.lit(0.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return both.select(*key, "candidate", score.alias("score"), F.col("exact_score").isNotNull().alias("exact")).where("score > 0 or exact")


def title_candidates(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Rows with the pages of their block's content (doc_id, block_index, page_index, normalized_text) that share words with the title, and its score there."""
    pages = content.select("doc_id", "block_index", F.col("page_index").alias("candidate"), "normalized_text")
    titles = rows.select(*ROW, "block_index", normalize_text(F.col("title")).alias("plain")).where(F.length("plain") >= K.TITLE_CHARS).withColumn("in_doc", F.col("doc_id"))
    pages = pages.withColumnRenamed("doc_id", "in_doc")
    return titles_on_pages(titles, pages, ROW, ["in_doc", "block_index"])


def unique_title(candidates: DataFrame, key: list[str] = ROW) -> DataFrame:
    """(key, destination, score): the only page with the whole title, else the best page that is good and clearly ahead."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("candidate"))
    ranked = candidates.withColumns({"place": F.row_number().over(order), "runner_up": F.lead("score").over(order)})
    hits = ranked.groupBy(*key).agg(F.count_if("exact").alias("n_exact"), F.max(F.when(F.col("exact"), F.col("candidate"))).alias("only"), F.max(F.when(F.col("place") == 1, F.struct("score", "candidate", "runner_up"))).alias("top"))
    clear = (F.col("top.score") >= K.TITLE_SCORE) & (F.col("top.runner_up").isNull() | (F.col("top.score") - F.col("top.runner_up") >= K.TITLE_LEAD))
    destination = F.when(F.col("n_exact") == 1, F.col("only")).when(clear, F.col("top.candidate"))
    return hits.select(*key, destination.alias("destination"), F.when(F.col("n_exact") == 1, F.lit(1.0)).otherwise(F.col("top.score")).alias("score"))


def _observed(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    seen = trusted.withColumnRenamed("page_index", "destination")
    out = rows.join(seen, ["doc_id", "block_index", "label_kind", "destination"], "left")
    return out.withColumn("observed", F.coalesce("observed", F.array().cast("array<int>")))


def resolve_rows(rows: DataFrame, segments: DataFrame, labels: DataFrame, pages: DataFrame, blocks: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """Per row: target_page or null, matched_by, confidence, reason and evidence (JSON)."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    trusted = trusted_labels(labels, segments)
    found = _observed(segment_candidates(rows, segments, counts), trusted)
    text = pages.select("doc_id", F.col("page_index").alias("destination"), "normalized_text")
    found = found.join(text, ["doc_id", "destination"])
    exact = F.array_contains("observed", F.col("printed_number"))
    title = title_match_score(normalize_text(F.col("title")), F.col("normalized_text"))
    found = found.withColumns({"exact": exact, "title_score": title}).drop("normalized_text")
    evidence = F.least(F.lit(K.EVIDENCE_CAP), F.col("evidence_pages") / K.EVIDENCE_PAGES)
    found = found.withColumns({"conflict": (F.size("observed") > 0) & ~F.col("exact"), "score": F.when(F.col("exact"), K.EXACT_LABEL).otherwise(0.0) + F.col("title_score") + evidence})
    order = Window.partitionBy(*ROW, "conflict").orderBy(F.desc("score"), F.desc("evidence_pages"), "destination")
    ranked = found.withColumns({"place": F.row_number().over(order), "runner_up": F.lead("score").over(order)})
    best = F.max(F.when(~F.col("conflict") & (F.col("place") == 1), F.struct("destination", "score", "runner_up", "exact", "title_score", "offset", "printed_start", "printed_end", "evidence_pages", "observed")))
    targets = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct((-F.col("score")).alias("s"), (-F.col("evidence_pages")).alias("e"), "destination")))), lambda x: x["destination"] + 1)
    by_segment = cut(ranked.groupBy(*ROW).agg(best.alias("best"), targets(~F.col("conflict")).alias("viable"), targets(F.lit(True)).alias("all_targets")))

    content = pages.join(toc_pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti")
    content = content.join(blocks.select("doc_id", "block_index", "region_start", "region_end"), "doc_id").where("page_index between region_start and region_end")
    alone = cut(rows.join(by_segment.select(*ROW), ROW, "left_anti"))
    titled = unique_title(title_candidates(alone, cut(content))).where("destination is not null").join(alone, ROW)
    titled = _observed(titled, trusted).select(*ROW, F.struct("destination", "score", "observed").alias("by_title"))

    out = rows.join(by_segment, ROW, "left").join(titled, ROW, "left")
    b, t, number = F.col("best"), F.col("by_title"), F.col("printed_number")
    ambiguous = b.isNotNull() & F.coalesce(F.abs(b["score"] - b["runner_up"]) < K.AMBIGUOUS, F.lit(False))
    segment = b.isNotNull() & ~ambiguous
    against = t.isNotNull() & (F.size(t["observed"]) > 0) & ~F.array_contains(t["observed"], number)
    by_name = t.isNotNull() & ~against
    none = F.lit(None)
    target = F.when(segment, b["destination"]).when(by_name, t["destination"])
    matched = F.when(segment, "pagination-segment").when(by_name, "unique-title")
    sure = F.when(segment, F.when(b["exact"] | (b["title_score"] >= K.HIGH_SEGMENT), "high").otherwise("medium")).when(by_name, F.when(t["score"] >= K.HIGH_TITLE, "high").otherwise("medium")).otherwise("low")
    reason = (
        F.when(segment | by_name, none)
        .when(ambiguous, "multiple pagination segments map this label")
        .when(F.col("all_targets").isNotNull(), "candidate destination has a conflicting printed page label")
        .when(against, "title match conflicts with destination page label")
        .otherwise("no safe pagination or unique title match")
    )
    evidence = (
        F.when(segment, F.to_json(F.struct("block_index", b["offset"].alias("offset"), F.array(b["printed_start"], b["printed_end"]).alias("segment_printed_range"), b["evidence_pages"].alias("segment_evidence_pages"), (~number.between(b["printed_start"], b["printed_end"])).alias("segment_extrapolated"), b["observed"].alias("target_margin_labels"), F.round(b["title_score"], 4).alias("target_title_score"))))
        .when(by_name, F.to_json(F.struct("block_index", t["observed"].alias("target_margin_labels"), F.round(t["score"], 4).alias("target_title_score"))))
        .when(against, F.to_json(F.struct((t["destination"] + 1).alias("candidate_target_page"), t["observed"].alias("target_margin_labels"), F.round(t["score"], 4).alias("target_title_score"))))
        .when(F.col("all_targets").isNotNull(), F.to_json(F.struct(F.when(ambiguous, F.col("viable")).otherwise(F.col("all_targets")).alias("candidate_target_pages"))))
    )
    return out.select(*rows.columns, target.alias("target_page"), matched.alias("matched_by"), sure.alias("confidence"), reason.alias("reason"), evidence.alias("evidence"))
