import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions import geometry, text, uri
from foliant.operators import gates, layout, links, pagination, verify
from foliant.sources import relations
from foliant.streaming.manifests import watch_manifests

RND = random.Random(12)


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numerals(spark):
    numbers = list(range(-2, 4100))
    numerals = column(spark, numbers, text.int_to_roman, "int")
    assert [n for n, r in zip(numbers, numerals, strict=True) if r] == list(range(1, 4000))
    assert column(spark, numerals, text.roman_to_int) == [n if 1 <= n <= 3999 else None for n in numbers]
    assert column(spark, ["iiii", "vx", "ic", "", "mmmm", "IV", "xiv", "abc", "IM"], text.roman_to_int) == [None] * 5 + [4, 14, None, None]


def test_normalized_text(spark):
    sample = ["Café & Bar", "STRASSE ẞß ﬁn", "  a--b  ", "", "ŉ ǰ ẖ", "Ünïcode Ёж"] + ["x" + chr(c) + "y" for c in RND.sample(range(32, 0xD7FF), 3000)]

    def want(s):
        folded = s.casefold().replace("&", " and ")
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in folded).split())

    got = column(spark, sample, text.normalize_text)
    assert [(s, g) for s, g in zip(sample, got, strict=True) if g != want(s) and unicodedata.category(s[1:2] or "a") != "Cn"] == []


def test_page_labels(spark):
    cases = {"12": (12, "arabic"), "(iv)": (4, "roman"), "· 7 ·": (7, "arabic"), "00012": None, "iiii": None, "12\n": (12, "arabic"), "x1": None, "[XIV]": (14, "roman"), "0": (0, "arabic"), "": None, "5": (5, "arabic"), None: None}
    got = column(spark, list(cases), text.parse_page_label)
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_addresses(spark):
    cases = {"https://example.com/security": ("https://example.com/security",) * 2, "www.example.org": ("https://www.example.org",) * 2, "security@example.com": ("mailto:security@example.com",) * 2, "(example.com),": (None, "https://example.com"), "report.pdf": (None, None), "example.com/a.pdf": (None, "https://example.com/a.pdf"), "": (None, None), "HTTP://X.org).": ("HTTP://X.org",) * 2, "plain": (None, None)}
    assert column(spark, list(cases), uri.normalized_uri) == [v[0] for v in cases.values()]
    assert column(spark, list(cases), lambda c: uri.normalized_uri(c, True)) == [v[1] for v in cases.values()]
    assert column(spark, ["http://a", "http:///a", "ftp://x/y", "mailto:a@b", "mailto:a?@", "file://a", None], uri.supported_uri) == [True, False, True, True, False, False, False]


def test_repository_urls(spark):
    good = ["https://github.com/Own/Repo.git", "git@github.com:own/repo", "ssh://git@github.com:22/own/repo/", " https://github.com/own/repo/ "]
    bad = ["http://github.com/a/b", "https://github.com/a", "https://user@github.com/a/b", "ssh://me@github.com/a/b", "https://github.com/a/b?x", "https://gitlab.com/a/b", "", None]
    assert column(spark, good + bad, text.repository_url) == ["https://github.com/own/repo"] * 4 + [None] * 8


def test_page_lists(spark):
    assert column(spark, ["2,3", " 3 ,1,3"], lambda c: text.page_list(c, F.lit(3))) == [[1, 2], [0, 2]]
    for bad in ("", "0", "4", "a"):
        with pytest.raises(Exception, match="invalid page list"):
            column(spark, [bad], lambda c: text.page_list(c, F.lit(3)))


def test_lines_against_a_plain_fold(spark):
    rows = [(f"d{d}", 0, i, f"w{i}", RND.choice([10.0, 20.0, 30.0]), 0.0, RND.uniform(0, 40), 0.0) for d in range(30) for i in range(RND.randint(0, 25))] + [("x", 0, i, "w", float(i), 0.0, t, 0.0) for i, t in enumerate([10.0, 12.5, 13.0, 15.0])]
    want = {}
    for d in {r[0] for r in rows}:
        out = []
        for w in sorted((r for r in rows if r[0] == d), key=lambda r: (r[6], r[4], r[2])):
            if out and abs(w[6] - sum(x[6] for x in out[-1]) / len(out[-1])) <= K.LINE_TOLERANCE:
                out[-1].append(w)
            else:
                out.append([w])
        for n, line in enumerate(out):
            want[d, n] = [w[2] for w in sorted(line, key=lambda r: r[4])]
    words = spark.createDataFrame(rows, "doc_id string, page_index int, word_seq int, text string, x0 double, x1 double, top double, bottom double")
    got = {(r["doc_id"], r["line_no"]): [w["word_seq"] for w in r["words"]] for r in layout.group_lines(words).collect()}
    assert got == want and len([k for k in got if k[0] == "x"]) == 2


def test_continuation_against_a_fixpoint(spark):
    rows, want = [], set()
    for d in range(60):
        seed, ok = ({p for p in range(15) if RND.random() < q} for q in (0.15, 0.5))
        have = set(seed)
        while more := {p for p in ok - have if {p - 1, p + 1} & have}:
            have |= more
        want |= {(d, p) for p in have}
        rows += [(d, p, p in seed, p in ok) for p in range(15)]
    got = pagination.expand_continuation(spark.createDataFrame(rows, "doc_id int, page_index int, seed boolean, eligible boolean"))
    assert {tuple(r) for r in got.collect()} == want


def test_sessions_break_at_gaps(spark):
    rows = spark.createDataFrame([("a", p) for p in (1, 25, 50, 74, 99)], "g string, page_index int")
    assert [r["session"] for r in pagination.page_sessions(rows, ["g"]).orderBy("page_index").collect()] == [0, 0, 1, 1, 2]


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    least = min((r[2] - r[0]) * (r[3] - r[1]) for r in (a, b))
    return w * h / least if w > 0 and h > 0 and least > 0 else 0.0


def test_claims_against_a_plain_loop(spark):
    def rect():
        x, y = RND.uniform(0, 6), RND.uniform(0, 6)
        return [x, y, x + RND.uniform(1, 4), y + RND.uniform(1, 4)]

    rows = [(f"d{d}", 0, i, rect()) for d in range(20) for i in range(25)]
    held = [(f"d{d}", 0, rect()) for d in range(10)]
    want = {}
    for d in {r[0] for r in rows}:
        there = [h[2] for h in held if h[0] == d]
        for _, _, i, r in (x for x in rows if x[0] == d):
            want[d, i] = not any(overlap(r, t) >= 0.8 for t in there)
            if want[d, i]:
                there.append(r)
    got = links.greedy_claims(spark.createDataFrame(rows, "doc_id string, page_index int, seq int, rect array<double>"), spark.createDataFrame(held, "doc_id string, page_index int, rect array<double>"))
    assert {(r["doc_id"], r["seq"]): r["claimed"] for r in got.collect()} == want
    assert len(set(want.values())) == 2


def test_tolerant_match_against_a_plain_loop(spark):
    def make(n):
        return [(f"d{RND.randint(0, 4)}", 1, RND.choice(["internal", "external", "other"]), 2, "u", [RND.choice([0.0, 0.3, 0.6, 0.9])] + [1.0] * 3, i) for i in range(n)]

    a, b = make(60), make(60)
    left, lost = list(b), set()
    for e in a:
        hit = next((x for x in left if x[:5] == e[:5] and all(abs(p - q) <= 0.5 for p, q in zip(x[5], e[5], strict=True))), None)
        if hit:
            left.remove(hit)
        else:
            lost.add(("missing", e[6]))
    schema = "doc_id string, source_page int, kind string, target_page int, uri string, rect array<double>, seq long"
    got = verify.tolerant_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert {(r["side"], r["seq"]) for r in got.collect()} == lost | {("unexpected", x[6]) for x in left}


def test_rect_errors(spark):
    nan = float("nan")
    cases = [(None, "missing or malformed /Rect"), ([1.0], "missing or malformed /Rect"), ([0.0, 0.0, None, 1.0], "non-numeric /Rect"), ([0.0, nan, 1.0, 1.0], "non-finite /Rect"), ([1.0, 0.0, 0.0, 1.0], "empty or reversed /Rect"), ([0.0, 0.0, 10.02, 1.0], "out-of-page /Rect"), ([0.0, 0.0, 10.005, 1.0], None)]
    assert column(spark, [r for r, _ in cases], lambda c: geometry.rect_error(c, geometry.rect(0, 0, 10, 10)), "array<double>") == [e for _, e in cases]


def test_manifests_as_files_and_as_a_stream(spark, tmp_path):
    digest = "a" * 64
    rect = "[1, 1, 5, 2]"
    files = {
        "good": f'{{"schema_version": 2, "status": "PASS", "input_sha256": "{digest.upper()}", "links": [{{"kind": "internal", "source_page_index": 0, "target_page": 1, "rect": {rect}}}]}}',
        "page": f'{{"schema_version": 2, "status": "PASS", "input_sha256": "{digest}", "links": [{{"kind": "internal", "source_page": 7, "target_page": 1, "rect": {rect}}}]}}',
        "review": f'{{"schema_version": 2, "status": "NEEDS_REVIEW", "input_sha256": "{digest}", "links": []}}',
        "legacy": f'{{"schema_version": 1, "source_sha256": "{digest}", "links": []}}',
    }
    (tmp_path / "in").mkdir()
    for name, body in files.items():
        (tmp_path / "in" / f"{name}.json").write_text(body)
    documents = spark.createDataFrame([("d", digest, 3)], "doc_id string, input_sha256 string, page_count int")
    rows = relations.read_manifests(spark, str(tmp_path / "in")).withColumn("doc_id", F.lit("d"))
    want = sorted([(1, "invalid source page"), (0, "manifest is neither PASS nor reviewed"), (0, "manifest schema_version is not supported")])
    assert sorted((r["position"], r["error"]) for r in verify.validate_manifests(rows, documents).collect()) == want
    assert verify.validate_manifests(rows, documents, allow_legacy=True).count() == 2
    query = watch_manifests(spark, str(tmp_path / "in"), documents, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted((r["position"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n/FT /Sig /XFA")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7\nplain")
    found = {r["path"][-5:]: r for r in relations.pdf_headers(spark, f"{tmp_path}/*.pdf").collect()}
    assert found["a.pdf"]["has_signature"] and found["a.pdf"]["features"] == ["xfa"] and found["b.pdf"]["pdf_header"] == "%PDF-1.7" and not found["b.pdf"]["has_signature"]
    assert all(len(r["sha256"]) == 64 for r in relations.file_digests(spark, f"{tmp_path}/*.pdf").collect())
    named = relations.output_paths(spark.createDataFrame([("/x/book.pdf",)], "path string")).first()
    assert named["output"] == "/x/linked/book-linked.pdf"


def test_fields_hang_on_the_form(spark):
    chain = [(1, i, i - 1 if i else None, i == 40) for i in range(41)]
    circle = [(2, 1, 2, True), (2, 2, 1, False), (2, 3, 3, True), (2, 4, None, False), (2, 5, 9, True), (2, 6, 5, True), (2, 7, 4, False)]
    fields = spark.createDataFrame(chain + circle + [(3, 1, None, False)], "doc_id int, field int, parent int, signature boolean")
    held = {(r["doc_id"], r["field"]) for r in gates.reachable_fields(fields).collect()}
    assert held == {(1, i) for i in range(41)} | {(2, 4), (2, 7), (3, 1)}
    documents = spark.createDataFrame([(1, None, None, None), (2, False, True, True), (3, True, False, False), (4, None, False, None)], "doc_id int, has_perms boolean, has_collection boolean, has_xfa boolean")
    assert {r["doc_id"]: r["has_signature"] for r in gates.has_signature(documents, fields).collect()} == {1: True, 2: False, 3: True, 4: False}
    told = {(r["doc_id"], r["reason"]) for r in gates.refused(documents, fields).collect()}
    assert told == {(1, "the document is signed"), (3, "the document is signed"), (2, "unsupported features: PDF portfolio/collection, XFA form")}
    assert {r["doc_id"] for r in gates.refused(documents, fields, allow_signed=True).collect()} == {2}
    assert gates.reachable_fields(fields.where("false")).count() == 0


def test_overlaps_are_found_in_bands(spark):
    rnd = random.Random(5)
    box = lambda: [x := rnd.uniform(-50, 500), y := rnd.uniform(-200, 900), x + rnd.uniform(-5, 90), y + rnd.uniform(-5, 300)]
    mine = [(1, i, i % 3, box()) for i in range(150)] + [(1, 900, 0, None), (1, 901, 0, [0.0, float("nan"), 1.0, 1.0]), (1, 902, 1, [0.0, -1e9, 600.0, 1e9])]
    there = [(1, i % 3, "internal", box(), i, None) for i in range(150)]
    a = spark.createDataFrame(mine, "doc_id int, link_seq int, source_page int, rect array<double>")
    b = spark.createDataFrame(there, "doc_id int, page_index int, kind string, rect array<double>, target_page int, uri string")

    def ratio(r, q):
        if r is None:
            return 0
        w, h = min(r[2], q[2]) - max(r[0], q[0]), min(r[3], q[3]) - max(r[1], q[1])
        area = min(max(0, r[2] - r[0]) * max(0, r[3] - r[1]), max(0, q[2] - q[0]) * max(0, q[3] - q[1]))
        return w * h / area if w > 0 and h > 0 and area > 0 else 0

    want = sorted((i, t) for _, i, p, r in mine for _, q, _, s, t, _ in there if p == q and ratio(r, s) >= 0.8)
    assert sorted((r["link_seq"], r["there_target"]) for r in links.overlapping_links(a, b).collect()) == want and len(want) > 20
