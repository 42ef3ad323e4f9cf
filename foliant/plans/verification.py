"""Verification as one plan: a source, its output and the report between them -> status and errors by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import verify

#: Columns of a page that a change of links must leave alone, in the order in which they are compared.
PAGE_COLUMNS = ["mediabox", "cropbox", "rotate", "content_sha256", "resources_sha256"]


def verify_plan(reports: DataFrame, files: DataFrame, source_pages: DataFrame, output_pages: DataFrame, source_links: DataFrame, output_links: DataFrame, columns: list[str] = PAGE_COLUMNS) -> DataFrame:
    """(doc_id, status, errors, warnings) of every document in ``files``; PASS without errors, else FAIL.

    ``reports`` and ``files`` as for ``report_errors``; pages: doc_id, page_index, mediabox and the compared ``columns``;
    links: doc_id, source_page (1-based), kind, target_page (1-based), uri, rect, seq. A document without a report fails.
    """
    page = F.concat(F.lit("page "), (F.col("page_index") + 1).cast("string"))
    parity = verify.page_parity(source_pages, output_pages, columns).select("doc_id", F.lit("error").alias("level"), F.concat(page, F.lit(": "), F.when(F.col("fault").isin("added", "missing"), F.concat(F.lit("is "), F.col("fault"))).otherwise(F.concat(F.col("fault"), F.lit(" differs")))).alias("message"))
    number = F.concat(F.lit("link "), F.col("link_no").cast("string"), F.lit(" on page "), F.col("source_page").cast("string"), F.lit(" "))
    faults = verify.verify_link_errors(output_links.withColumn("link_no", F.col("seq")), output_pages).select("doc_id", "level", F.concat(number, F.col("message")).alias("message"))
    told = verify.report_errors(reports, files, source_links, output_links).select("doc_id", F.lit("error").alias("level"), F.col("error").alias("message"))
    silent = files.join(reports, "doc_id", "left_anti").select("doc_id", F.lit("error").alias("level"), F.lit("no report").alias("message"))
    found = parity.unionByName(faults).unionByName(told).unionByName(silent).distinct()
    listed = lambda level: F.sort_array(F.collect_list(F.when(F.col("level") == level, F.col("message"))))
    by_doc = found.groupBy("doc_id").agg(listed("error").alias("errors"), listed("warning").alias("warnings"))
    none = F.array().cast("array<string>")
    out = files.select("doc_id").distinct().join(by_doc, "doc_id", "left").withColumns({"errors": F.coalesce("errors", none), "warnings": F.coalesce("warnings", none)})
    return out.select("doc_id", F.when(F.size("errors") > 0, "FAIL").otherwise("PASS").alias("status"), "errors", "warnings")
