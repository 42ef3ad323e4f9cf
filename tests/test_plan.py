"""Whole documents: what is linked, what is left for review."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx  # noqa: E402

from foliant.operators import links, verify  # noqa: E402
from foliant.plans.plan import Options, automatic_plan, reference_plan, replay_plan, replay_review, report, status  # noqa: E402
from foliant.plans.verification import verify_plan  # noqa: E402

ANNOTATIONS = "doc_id string, page_index int, annot_seq int, subtype string, dest string, action string, rect array<double>, target_page int, uri string, contents string"

WORDS = "doc_id string, page_index int, word_seq int, text string, x0 double, x1 double, top double, bottom double"
PAGES = "doc_id string, page_index int, width double, height double, rotate int"
MADE = {b.name: b for b in [fx.two_numberings(), fx.restarting(), fx.skipping(), fx.skipping("lost", lost=1), fx.blotted(), fx.addresses(), fx.addresses("rotated"), fx.Book("blank").page()]}


@pytest.fixture(scope="module")
def books(spark):
    made = list(MADE.values())
    words = spark.createDataFrame([w for b in made for w in b.words], WORDS)
    pages = spark.createDataFrame([(b.name, i, fx.WIDTH, fx.HEIGHT, 90 if b.name == "rotated" else 0) for b in made for i in range(b.pages)], PAGES)
    return words, pages


@pytest.fixture(scope="module")
def plan(spark, books):
    return automatic_plan(*books, spark.createDataFrame([], ANNOTATIONS))


@pytest.fixture(scope="module")
def targets(plan):
    out = {}
    for r in plan.links.where("kind = 'internal'").collect():
        out.setdefault(r["doc_id"], {})[r["title"], r["printed_label"]] = r["target_page"] + 1
    return out


@pytest.mark.parametrize("name", ["mixed", "volumes", "skips", "lost", "blotted"])
def test_rows_lead_to_the_pages_they_were_drawn_for(targets, name):
    assert targets[name] == MADE[name].targets


@pytest.mark.parametrize("seed", range(31, 34))
def test_other_books(spark, seed):
    made = [fx.two_numberings("a", seed), fx.restarting("b", seed, 2 + seed % 2), fx.skipping("c", seed)]
    words = spark.createDataFrame([w for b in made for w in b.words], WORDS)
    pages = spark.createDataFrame([(b.name, i, fx.WIDTH, fx.HEIGHT, 0) for b in made for i in range(b.pages)], PAGES)
    found = automatic_plan(words, pages, spark.createDataFrame([], ANNOTATIONS)).links.collect()
    assert {(r["doc_id"], r["title"], r["printed_label"], r["target_page"] + 1) for r in found} == {(b.name, *k, p) for b in made for k, p in b.targets.items()}


def test_segments(plan):
    rows = {}
    for r in plan.segments.collect():
        rows.setdefault(r["doc_id"], set()).add((r["block_index"], r["label_kind"], r["offset"], r["evidence_pages"], r["density"]))
    want = {}
    for name in ("mixed", "volumes", "skips"):  # a run of pages is one offset between its labels and its pages
        block, last = -1, None
        for (title, label), page in MADE[name].targets.items():
            roman = label in fx.ROMAN
            number = fx.ROMAN.index(label) if roman else int(label)
            block += number == 1 and (name == "volumes" or last is None)
            key = (block, "roman" if roman else "arabic", page - number)
            want.setdefault(name, {}).setdefault(key, []).append(number)
            last = number
    assert {n: rows[n] for n in want} == {n: {(*k, len(v), 1.0) for k, v in x.items()} for n, x in want.items()}


def test_a_number_that_no_page_bears_stays_open(plan):
    missing = [r["printed_label"] for r in plan.unresolved.where("doc_id = 'lost'").collect()]
    assert len(missing) == 1 and missing[0] not in {label for _, label in MADE["lost"].targets}


def test_an_unreadable_numeral_is_suspected(plan):
    row = plan.completeness.where("doc_id = 'blotted'").first()
    n = len(MADE["blotted"].targets)
    assert (row["parsed_rows"], row["candidate_lines"], row["suspected_unparsed_rows"]) == (n, n + 1, 1)


def test_addresses(plan):
    uris = {r["label"]: r["uri"] for r in plan.links.where("doc_id = 'addresses'").collect()}
    assert uris == fx.ADDRESSES
    skipped = {r["doc_id"]: r["skipped_bare_domain_candidates"] for r in plan.skipped_bare_domains.collect()}
    assert skipped["addresses"] == len(fx.LOOKALIKES)


def test_review(plan, books):
    found = {r["doc_id"]: (r["status"], r["review_reasons"]) for r in status(plan.review, books[1]).collect()}
    assert [d for d in sorted(found) if found[d][0] == "PASS"] == ["addresses", "mixed", "skips", "volumes"]
    assert found["rotated"][1] == ["addresses on rotated pages", "nothing to link"]
    assert "suspected unparsed contents rows" in found["blotted"][1] and "unresolved contents rows" in found["lost"][1]
    assert "no extractable text" in found["blank"][1]
    rows = {r["doc_id"]: r for r in report(plan, books[1]).collect()}
    n = len(MADE["mixed"].targets)
    assert len(rows) == len(MADE) and rows["mixed"]["added_links"]["internal"] == n and len(rows["mixed"]["links"]) == n


def test_options(spark, books):
    words, pages = (x.where("doc_id in ('mixed', 'addresses')") for x in books)
    none = spark.createDataFrame([], ANNOTATIONS)
    only_urls = automatic_plan(words, pages, none, Options(toc_links=False, allow_bare_domains=True))
    assert {(r["doc_id"], r["kind"]) for r in only_urls.links.collect()} == {("addresses", "external")} and only_urls.links.count() == len(fx.ADDRESSES) + len(fx.LOOKALIKES)
    arabic = {k: p for k, p in MADE["mixed"].targets.items() if k[1] not in fx.ROMAN}
    offset = {p - int(label) for (_, label), p in arabic.items()}
    given = automatic_plan(words, pages, none, Options(url_links=False, page_offset=offset.pop()))
    assert {(r["title"], r["printed_label"]): r["target_page"] + 1 for r in given.links.collect() if r["printed_label"] not in fx.ROMAN} == arabic and not offset


def test_replay(spark, plan):
    wanted = plan.links.where("doc_id = 'mixed'").select("doc_id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("printed_number", "label_kind")).alias("link_seq"), "kind", "source_page", "rect", "target_page", "uri", "label")
    first = wanted.where("link_seq <= 2").collect()
    there = [("mixed", r["source_page"], i, "/Link", "x", "/GoTo", r["rect"], r["target_page"] if i == 0 else 0, None, None) for i, r in enumerate(first)]
    rows = {r["link_seq"]: r["status"] for r in replay_plan(wanted, spark.createDataFrame(there, ANNOTATIONS)).collect()}
    n = len(MADE["mixed"].targets)
    assert rows == {1: "covered", 2: "conflict", **{i: "add" for i in range(3, n + 1)}}
    again = wanted.union(wanted.withColumn("link_seq", F.col("link_seq") + 100))
    assert replay_plan(again, spark.createDataFrame([], ANNOTATIONS)).where("status = 'conflict'").count() == n
    assert links.link_counts(wanted).first()["internal"] == n


def test_reported_links_match_output(spark):
    link = "struct<kind:string,source_page:int,source_page_index:int,target_page:int,target_page_index:int,rect:array<double>,uri:string,confidence:string,matched_by:string>"
    schema = f"doc_id string, schema_version int, status string, mode string, input_sha256 string, output_sha256 string, pages int, unresolved_toc_rows array<string>, suspected_unparsed_toc_rows int, existing_links map<string,int>, added_links map<string,int>, final_links map<string,int>, links array<{link}>"
    rect = [1.0, 1.0, 9.0, 2.0]
    good = ("a", 2, "PASS", "automatic-analysis", "A" * 64, "b" * 64, 3, [], 0, {"external": 1}, {"internal": 1}, {"internal": 1, "external": 1}, [("internal", 0, None, 2, None, rect, None, "high", "unique-title")])
    bad = ("b", 1, "NEEDS_REVIEW", "automatic-analysis", None, "c" * 64, 4, ["x"], 1, None, {"internal": 2}, {}, [("internal", 0, None, 1, None, rect, None, "low", "physical-page-fallback")])
    files = spark.createDataFrame([(d, "a" * 64, "b" * 64, 3) for d in "ab"], "doc_id string, source_file_sha256 string, output_file_sha256 string, page_count int")
    link_rows = "doc_id string, source_page int, kind string, target_page int, uri string, rect array<double>, seq long"
    source = spark.createDataFrame([(d, 2, "external", None, "http://x", rect, 1) for d in "ab"], link_rows)
    output = source.union(spark.createDataFrame([(d, 1, "internal", 3, None, [1.2, 1.0, 9.0, 2.0], 2) for d in "ab"], link_rows))
    errors = {}
    for r in verify.report_errors(spark.createDataFrame([good, bad], schema), files, source, output).collect():
        errors.setdefault(r["doc_id"], set()).add(r["error"])
    assert "a" not in errors
    assert {"schema_version must be 2", "status is not PASS", "input_sha256 is required and must be a SHA-256 digest", "output_sha256 does not match its file", "page count does not match", "unresolved contents rows", "existing_links is required", "added internal count does not match the links", "an automatic link lacks accepted confidence", "a link uses a physical page fallback", "a reported link has no matching output link", "an output link is not accounted for"} <= errors["b"]


def test_reference_copy(spark):
    rect, far = [10.0, 10.0, 60.0, 20.0], [200.0, 10.0, 260.0, 20.0]
    reference = [(d, 0, 0, "/Link", "x", "/GoTo", rect, 2, None, None) for d in "abc"] + [("a", 0, 1, "/Link", "y", "/GoTo", far, None, None, None), ("a", 1, 0, "/Link", None, "/URI", rect, None, "https://x.org/", None), ("b", 1, 0, "/Link", None, "/URI", rect, None, None, None), ("a", 1, 1, "/Text", None, None, rect, None, None, None)]
    there = [("b", 0, 0, "/Link", "x", "/GoTo", rect, 1, None, None)]
    pages = lambda odd: spark.createDataFrame([(d, i, [0.0, 0.0, 300.0, 400.0 + (d == odd)], [0.0, 0.0, 300.0, 400.0], 0) for d in "abc" for i in range(3)], "doc_id string, page_index int, mediabox array<double>, cropbox array<double>, rotate int")
    planned, review = reference_plan(spark.createDataFrame(reference, ANNOTATIONS), pages(""), spark.createDataFrame(there, ANNOTATIONS), pages("c"))
    assert {(r["doc_id"], r["source_page"], r["kind"], r["target_page"], r["uri"], r["status"]) for r in planned.collect()} == {("a", 0, "internal", 2, None, "add"), ("a", 1, "external", None, "https://x.org/", "add"), ("b", 0, "internal", 2, None, "conflict")}
    assert {tuple(r) for r in review.collect()} == {("c", "layout differs from the reference"), ("a", "unresolvable reference links"), ("b", "unresolvable reference links"), ("b", "replayed links overlap links with other destinations")}
    assert {r["doc_id"]: r["status"] for r in status(review, pages("")).collect()} == dict.fromkeys("abc", "NEEDS_REVIEW")
    assert [tuple(r) for r in replay_review(planned).collect()] == [("b", "replayed links overlap links with other destinations")]


def test_verification_of_a_whole_output(spark):
    page = "doc_id string, page_index int, mediabox array<double>, cropbox array<double>, rotate int, content_sha256 string, resources_sha256 string"
    box = [0.0, 0.0, 100.0, 100.0]
    pages = lambda changed: spark.createDataFrame([(d, i, box, box, 0, f"{d}{i}" + ("!" if (d, i) in changed else ""), "r") for d in "abc" for i in range(2)], page)
    rect = [1.0, 1.0, 9.0, 2.0]
    link_rows = "doc_id string, source_page int, kind string, target_page int, uri string, rect array<double>, seq long"
    source = spark.createDataFrame([(d, 2, "external", None, "http://x", rect, 1) for d in "abc"], link_rows)
    output = source.union(spark.createDataFrame([(d, 1, "internal", 2 if d == "a" else 9, None, rect, 2) for d in "ab"], link_rows))
    schema = "doc_id string, schema_version int, status string, mode string, input_sha256 string, output_sha256 string, pages int, unresolved_toc_rows array<string>, suspected_unparsed_toc_rows int, existing_links map<string,int>, added_links map<string,int>, final_links map<string,int>, links array<struct<kind:string,source_page:int,source_page_index:int,target_page:int,target_page_index:int,rect:array<double>,uri:string,confidence:string,matched_by:string>>"
    told = [(d, 2, "PASS", "automatic-analysis", "a" * 64, "b" * 64, 2, [], 0, {"external": 1}, {"internal": 1}, {"internal": 1, "external": 1}, [("internal", 0, None, 1 if d == "a" else 8, None, rect, None, "high", "unique-title")]) for d in "ab"]
    files = spark.createDataFrame([(d, "a" * 64, "b" * 64, 2) for d in "abc"], "doc_id string, source_file_sha256 string, output_file_sha256 string, page_count int")
    found = {r["doc_id"]: r for r in verify_plan(spark.createDataFrame(told, schema), files, pages([]), pages([("b", 1)]), source, output).collect()}
    assert (found["a"]["status"], found["a"]["errors"]) == ("PASS", [])
    assert found["b"]["status"] == "FAIL" and found["b"]["errors"] == ["link 2 on page 1 has an unresolved or invalid internal destination", "page 2: content_sha256 differs"]
    assert found["c"]["errors"] == ["no report"]


def test_command_line(spark, books, tmp_path):
    from foliant.__main__ import main

    words, pages = (x.where("doc_id = 'mixed'") for x in books)
    words.write.parquet(f"{tmp_path}/words")
    pages.write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([], ANNOTATIONS).write.parquet(f"{tmp_path}/annotations")
    main(["plan", "--words", f"{tmp_path}/words", "--pages", f"{tmp_path}/pages", "--annotations", f"{tmp_path}/annotations", "--out", f"{tmp_path}/out", "--no-url-links"])
    row = spark.read.json(f"{tmp_path}/out").first()
    assert row["status"] == "PASS" and len(row["links"]) == len(MADE["mixed"].targets)
