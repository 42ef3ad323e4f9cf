"""``python -m foliant plan|replay``: link plans of tables of words, pages and annotations, as JSON reports."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliant.plans.plan import Options, automatic_plan, replay_plan, report
from foliant.sources.relations import read_manifests, write_reports


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliant", description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    plan = modes.add_parser("plan", help="links from contents rows and visible addresses")
    plan.add_argument("--words", required=True)
    plan.add_argument("--pages", required=True)
    plan.add_argument("--page-offset", type=int)
    plan.add_argument("--allow-bare-domains", action="store_true")
    replay = modes.add_parser("replay", help="links of reviewed manifests")
    replay.add_argument("--manifests", required=True)
    for mode in (plan, replay):
        mode.add_argument("--annotations", required=True)
        mode.add_argument("--out", required=True)
        mode.add_argument("--no-toc-links", action="store_true")
        mode.add_argument("--no-url-links", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    annotations = spark.read.parquet(given.annotations)
    if given.mode == "plan":
        options = Options(not given.no_toc_links, not given.no_url_links, given.allow_bare_domains, given.page_offset)
        pages = spark.read.parquet(given.pages)
        write_reports(report(automatic_plan(spark.read.parquet(given.words), pages, annotations, options), pages), given.out)
        return
    links = read_manifests(spark, given.manifests).selectExpr("path as doc_id", "posexplode(links) as (link_seq, l)").selectExpr("doc_id", "link_seq", "l.kind as kind", "coalesce(l.source_page_index, l.source_page) as source_page", "l.rect as rect", "coalesce(l.target_page_index, l.target_page) as target_page", "l.uri as uri", "l.label as label")
    write_reports(replay_plan(links, annotations, not given.no_toc_links, not given.no_url_links), given.out)


if __name__ == "__main__":
    main()
