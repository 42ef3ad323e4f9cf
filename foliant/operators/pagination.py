"""Runs of pages, contents blocks, and the offsets between printed and physical pages.

All windows are partitioned by document; a document's pages are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant import constants as K


def contiguous_groups(rows: DataFrame, value: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, start, end): the maximal runs of distinct whole numbers."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return rows.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(value).alias("start"), F.max(value).alias("end")).drop("__island")


def expand_continuation(pages: DataFrame, by: str = "doc_id", page: str = "page_index") -> DataFrame:
    """``pages`` (by, page, seed, eligible) -> (by, page): the runs of seeds and eligible pages that hold a seed.

    That is the fixpoint of adding eligible neighbours, found in one pass.
    """
    part = pages.where("seed or eligible").groupBy(by, page).agg(F.bool_or("seed").alias("seed"))
    part = part.withColumn("__island", F.col(page) - F.row_number().over(Window.partitionBy(by).orderBy(page)))
    return part.withColumn("__held", F.bool_or("seed").over(Window.partitionBy(by, "__island"))).where("__held").select(by, page)


def detect_toc_pages(facts: DataFrame, seeds: DataFrame, explicit: bool = False) -> DataFrame:
    """Contents pages: the seeds and, unless they were given explicitly, the pages that continue them."""
    if explicit:
        return seeds.select("doc_id", "page_index").distinct()
    marked = facts.join(seeds.select("doc_id", "page_index", F.lit(True).alias("seed")), ["doc_id", "page_index"], "left")
    eligible = F.greatest("candidate_lines", "ordinal_anchors") >= K.ROWS_OF_CONTINUATION
    return expand_continuation(marked.select("doc_id", "page_index", F.coalesce("seed", F.lit(False)).alias("seed"), eligible.alias("eligible")))


def contents_blocks(toc_pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, block_index, start_page, end_page, region_start, region_end): each run of contents pages and what follows it."""
    runs = contiguous_groups(toc_pages, "page_index", ["doc_id"])
    order = Window.partitionBy("doc_id").orderBy("start")
    runs = runs.withColumns({"block_index": F.row_number().over(order) - 1, "next": F.lead("start").over(order)}).join(page_counts, "doc_id")
    return runs.select("doc_id", "block_index", F.col("start").alias("start_page"), F.col("end").alias("end_page"), (F.col("end") + 1).alias("region_start"), (F.coalesce("next", "page_count") - 1).alias("region_end"))


def in_region(rows: DataFrame, blocks: DataFrame, page: str = "page_index") -> DataFrame:
    """Rows with the block whose content region holds their page; pages before the first block belong to none."""
    parts = blocks.select("doc_id", "block_index", "region_start", "region_end")
    return rows.join(parts, "doc_id").where(F.col(page).between(F.col("region_start"), F.col("region_end")))


def offset_histogram(observations: DataFrame) -> DataFrame:
    """``observations`` (doc_id, block_index, label_kind, page_index, printed_number) -> pages of each offset."""
    return observations.withColumn("offset", F.col("page_index") + 1 - F.col("printed_number")).groupBy("doc_id", "block_index", "label_kind", "offset").agg(F.countDistinct("page_index").alias("n_pages"))


def support(region_start: str = "region_start", region_end: str = "region_end"):
    return F.when(F.col(region_end) - F.col(region_start) < K.SHORT_REGION, K.SUPPORT_SHORT).otherwise(K.SUPPORT_LONG)


def retained_offsets(histogram: DataFrame, blocks: DataFrame) -> DataFrame:
    """Offsets seen on enough pages, by themselves and next to the dominant one of their block and kind."""
    sized = histogram.join(blocks.select("doc_id", "block_index", support().alias("support")), ["doc_id", "block_index"])
    dominant = F.max("n_pages").over(Window.partitionBy("doc_id", "block_index", "label_kind"))
    share = F.floor(dominant * F.lit(K.DOMINANT_SHARE))
    n = F.col("n_pages")
    kept = (n >= F.col("support")) & ((n >= F.greatest(F.col("support").cast("long"), share)) | (n >= K.AMPLE_SUPPORT))
    return sized.withColumn("__kept", kept).where("__kept").drop("__kept")


def page_sessions(rows: DataFrame, by: list[str], page: str = "page_index", gap: int = K.PAGE_GAP) -> DataFrame:
    """Rows with ``session``: a new one where the page lies more than ``gap`` after the one before in its group."""
    order = Window.partitionBy(*by).orderBy(page)
    fresh = F.when(F.col(page) - F.lag(page).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("__fresh", fresh).withColumn("session", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def pagination_segments(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """The stretches in which printed labels run at one offset from the physical pages.

    ``labels``: doc_id, page_index, printed_number, label_kind. Offsets with enough support are cut into sessions;
    a session stays if it has support and, when short, labels dense enough.
    """
    seen = in_region(labels, blocks).withColumn("offset", F.col("page_index") + 1 - F.col("printed_number"))
    kept = retained_offsets(offset_histogram(seen), blocks).select("doc_id", "block_index", "label_kind", "offset", "support")
    key = ["doc_id", "block_index", "label_kind", "offset"]
    each = seen.select(*key, "page_index", "printed_number").distinct().join(kept, key)
    grouped = page_sessions(each, key).groupBy(*key, "session").agg(F.min("printed_number").alias("printed_start"), F.max("printed_number").alias("printed_end"), F.count("*").alias("evidence_pages"), F.countDistinct("printed_number").alias("labels"), F.first("support").alias("support"))
    density = F.col("labels") / (F.col("printed_end") - F.col("printed_start") + 1)
    grouped = grouped.withColumn("density", density).where((F.col("evidence_pages") >= F.col("support")) & ((F.col("evidence_pages") >= K.SPARSE_CLUSTER) | (F.col("density") >= K.LEAST_DENSITY)))
    return grouped.select("doc_id", "block_index", "label_kind", "printed_start", "printed_end", "offset", "evidence_pages", F.round("density", 4).alias("density"), (F.col("printed_start") + F.col("offset")).alias("physical_start"), (F.col("printed_end") + F.col("offset")).alias("physical_end"))


def pagination_diagnostics(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per block, with 1-based pages: its contents pages, its content region and the labels seen there."""
    seen = in_region(labels, blocks).groupBy("doc_id", "block_index").agg(F.count("*").alias("margin_observations"))
    pages = F.sequence(F.col("start_page") + 1, F.col("end_page") + 1)
    out = blocks.join(seen, ["doc_id", "block_index"], "left")
    return out.select("doc_id", "block_index", pages.alias("toc_pages"), F.array(F.col("region_start") + 1, F.col("region_end") + 1).alias("content_region"), F.coalesce("margin_observations", F.lit(0)).alias("margin_observations"))


def manual_offset_segments(rows: DataFrame, offset: int) -> DataFrame:
    """Segments for a given offset: one for each block and kind, over the numbers of its contents rows."""
    return rows.groupBy("doc_id", "block_index", "label_kind").agg(F.min("printed_number").alias("printed_start"), F.max("printed_number").alias("printed_end")).withColumns({"offset": F.lit(offset), "evidence_pages": F.lit(0).cast("long"), "density": F.lit(1.0)})


def single_offset(segments: DataFrame) -> DataFrame:
    """Per document: the offset if all segments share it (else null) and the largest evidence."""
    only = F.when(F.countDistinct("offset") == 1, F.max("offset"))
    return segments.groupBy("doc_id").agg(only.alias("detected_page_offset"), F.max("evidence_pages").alias("offset_evidence_pages"))
