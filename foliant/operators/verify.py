"""Verification: page parity, link validity, count reconciliation, one-to-one matching, manifest rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import constants as K
from foliant.functions.geometry import equivalent
from foliant.functions.uri import supported_uri
from foliant.operators.links import KINDS


def page_parity(source: DataFrame, output: DataFrame, columns: list[str], key: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """(key, fault): pages that are missing on one side or differ in a column, with the first column that differs."""
    keys = list(key)
    a = source.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = output.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    fault = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "missing")
    for c in columns:
        fault = fault.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c))
    return a.join(b, keys, "full").select(*keys, fault.alias("fault")).where("fault is not null")


def verify_link_errors(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, source_page, link_no, level, message): every fault of each link; several are possible.

    ``links``: doc_id, link_no, source_page (1-based), rect, kind, target_page (1-based), uri; ``pages``: mediabox by page.
    """
    boxes = pages.select("doc_id", (F.col("page_index") + 1).alias("source_page"), "mediabox")
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    rows = links.join(boxes, ["doc_id", "source_page"], "left").join(counts, "doc_id", "left")
    r, box, t = F.col("rect"), F.col("mediabox"), K.RECT_BOUNDS_VERIFY
    whole = F.coalesce(F.size(r) == 4, F.lit(False))
    faults = [
        (~whole, "error", "has no valid rectangle"),
        (whole & ((r[2] <= r[0]) | (r[3] <= r[1])), "error", "has an empty or inverted rectangle"),
        (whole & ((r[0] < box[0] - t) | (r[1] < box[1] - t) | (r[2] > box[2] + t) | (r[3] > box[3] + t)), "error", "rectangle lies outside the page bounds"),
        (whole & (F.col("kind") == "internal") & ~F.coalesce(F.col("target_page").between(F.lit(1), F.col("page_count")), F.lit(False)), "error", "has an unresolved or invalid internal destination"),
        (whole & (F.col("kind") == "external") & ~supported_uri(F.col("uri")), "error", "has an invalid external URI"),
        (whole & (F.col("kind") == "other"), "warning", "uses an unsupported or incomplete link action"),
    ]
    all_faults = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(i).alias("place"), F.lit(level).alias("level"), F.lit(text).alias("message"))) for i, (when, level, text) in enumerate(faults)]))
    return rows.select("doc_id", "source_page", "link_no", F.inline(all_faults)).drop("place")


def error_preview(errors: DataFrame, by: list[str], order: list[str], message: str = "message", limit: int = K.PREVIEW) -> DataFrame:
    """(by, preview): the first messages joined, and how many more there are."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = errors.select(*by, F.col(message).alias("m"), place.alias("p"))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") <= limit, F.struct("p", "m")))), lambda x: x["m"]), "; ")
    more = F.when(F.count("*") > limit, F.concat(F.lit("; plus "), (F.count("*") - limit).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return ranked.groupBy(*by).agg(F.concat(kept, more).alias("preview"))


def count_reconcile(existing: DataFrame, added: DataFrame, final: DataFrame) -> DataFrame:
    """(doc_id, kind, existing, added, final): kinds whose counts don't add up. All sides: doc_id and a row per link with kind."""
    sides = [side.select("doc_id", "kind", *[F.lit(1 if i == j else 0).alias(n) for j, n in enumerate(("existing", "added", "final"))]) for i, side in enumerate((existing, added, final))]
    sums = reduce(DataFrame.unionByName, sides).groupBy("doc_id", "kind").agg(*[F.sum(n).alias(n) for n in ("existing", "added", "final")])
    return sums.where(F.col("existing") + F.col("added") != F.col("final"))


def exact_match(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, occurrence, side): rows that one multiset has and the other lacks."""
    side = lambda rows, a, b: rows.select(*columns, F.lit(a).cast("long").alias("__a"), F.lit(b).cast("long").alias("__b"))
    # both sides are counted by value where they lie; only what is left over becomes rows
    counts = side(expected, 1, 0).unionByName(side(actual, 0, 1)).groupBy(*columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")).where("__a <> __b")
    over = F.explode(F.sequence((F.least("__a", "__b") + 1).cast("int"), F.greatest("__a", "__b").cast("int")))
    return counts.select(*columns, over.alias("occurrence"), F.when(F.col("__a") > F.col("__b"), "missing").otherwise("unexpected").alias("side"))


def tolerant_match(expected: DataFrame, actual: DataFrame, tolerance: float = K.RECT_MATCH) -> DataFrame:
    """One-to-one matching of links within a tolerance of their rectangles, first come, first served.

    Both sides: doc_id, source_page, kind, target_page, uri, rect and seq. Returns (doc_id, side, seq) of what stays alone:
    ``missing`` of the expected, ``unexpected`` of the actual.
    """
    key = ["doc_id", "source_page", "kind", "means"]
    means = F.when(F.col("kind") == "internal", F.col("target_page").cast("string")).when(F.col("kind") == "external", F.col("uri"))
    gather = lambda rows, name: rows.withColumn("means", F.coalesce(means, F.lit("\0"))).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "rect"))).alias(name))
    none = F.array().cast("array<struct<seq:bigint,rect:array<double>>>")
    both = gather(expected, "es").join(gather(actual, "xs"), key, "full").withColumns({"es": F.coalesce("es", none), "xs": F.coalesce("xs", none)})
    start = F.struct(F.col("xs").alias("left"), F.array().cast("array<bigint>").alias("lost"))

    def step(acc, e):
        at = F.array_position(F.transform(acc["left"], lambda x: equivalent(e["rect"], x["rect"], tolerance)), True).cast("int")
        rest = F.concat(F.slice(acc["left"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["left"], at + 1, F.size(acc["left"])))
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), F.when(at > 0, acc["lost"]).otherwise(F.concat(acc["lost"], F.array(e["seq"]))).alias("lost"))

    done = both.withColumn("end", F.aggregate("es", start, step))
    alone = F.concat(F.transform("end.lost", lambda s: F.struct(F.lit("missing").alias("side"), s.alias("seq"))), F.transform("end.left", lambda x: F.struct(F.lit("unexpected").alias("side"), x["seq"].alias("seq"))))
    return done.select("doc_id", F.inline(alone))


def page_selection(links: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, page): the first and last page, and the sources and targets of internal links, 1-based and within bounds."""
    ends = page_counts.select("doc_id", F.explode(F.array(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    inner = links.where("kind = 'internal'")
    pages = ends.union(inner.select("doc_id", F.col("source_page").cast("int"))).union(inner.select("doc_id", F.col("target_page").cast("int"))).distinct()
    return pages.join(page_counts, "doc_id").where(F.col("page").between(F.lit(1), F.col("page_count"))).select("doc_id", "page")


def path_collisions(paths: DataFrame) -> DataFrame:
    """``paths`` (name, path) -> (first, second, path): each further name of a path with its first; ``.`` and empty parts don't count."""
    plain = F.regexp_replace(F.regexp_replace("path", r"/(?:\./)+", "/"), r"/{2,}", "/")
    rows = paths.where("path is not null and name is not null").select("name", plain.alias("path")).distinct()
    first = rows.groupBy("path").agg(F.min("name").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "path").where("name <> first").select("first", F.col("name").alias("second"), "path")


HEX = r"\A[0-9a-fA-F]{64}\z"


def manifest_error(m: dict[str, Column], input_sha256: Column, allow_legacy: bool = False) -> Column:
    """The first rule of a document that a link manifest breaks, or null. ``m``: its fields as columns."""
    version, given, other = m["schema_version"], m["input_sha256"], m["source_sha256"]
    declared = F.coalesce(given, other)
    disagree = given.isNotNull() & other.isNotNull() & (F.lower(given) != F.lower(other))
    current = F.coalesce(version == 2, F.lit(False))
    return (
        F.when(m["links"].isNull(), F.lit("manifest must be an object with a links array"))
        .when(current & ~F.coalesce((m["status"] == "PASS") | m["reviewed"], F.lit(False)), F.lit("manifest is neither PASS nor reviewed"))
        .when(~current & F.lit(not allow_legacy), F.lit("manifest schema_version is not supported"))
        .when(disagree, F.lit("manifest hashes disagree"))
        .when(current & given.isNull(), F.lit("manifest requires input_sha256"))
        .when(declared.isNotNull() & ~declared.rlike(HEX), F.lit("manifest hash is not a SHA-256 digest"))
        .when(declared.isNotNull() & (F.lower(declared) != F.lower(input_sha256)), F.lit("manifest input_sha256 belongs to another file"))
    )


def manifest_link_error(link: Column, page_count: Column) -> Column:
    """The first rule that a link of a manifest breaks, or null. Page numbers have two names; the longer one counts."""
    source = F.coalesce(link["source_page_index"], link["source_page"])
    target = F.coalesce(link["target_page_index"], link["target_page"])
    r = link["rect"]
    inside = lambda p: F.coalesce((p >= 0) & (p < page_count), F.lit(False))
    return (
        F.when(link.isNull(), F.lit("link is not an object"))
        .when(~F.coalesce(link["kind"].isin("internal", "external"), F.lit(False)), F.lit("unsupported kind"))
        .when(~inside(source), F.lit("invalid source page"))
        .when(~F.coalesce((F.size(r) == 4) & (r[2] > r[0]) & (r[3] > r[1]), F.lit(False)), F.lit("invalid rectangle"))
        .when((link["kind"] == "internal") & ~inside(target), F.lit("invalid target page"))
        .when((link["kind"] == "external") & ~supported_uri(link["uri"]), F.lit("unsupported URI"))
    )


def validate_manifests(manifests: DataFrame, documents: DataFrame, allow_legacy: bool = False) -> DataFrame:
    """(doc_id, position, error): the first fault of each manifest; position 0 for the manifest itself, else of the link.

    ``documents``: doc_id, input_sha256 (of the file), page_count.
    """
    files = documents.select("doc_id", F.col("input_sha256").alias("__file"), "page_count")
    rows = manifests.join(files, "doc_id")
    fields = {c: F.col(c) for c in ("schema_version", "status", "reviewed", "input_sha256", "source_sha256", "links")}
    of_links = F.transform("links", lambda link, i: F.struct((i + 1).alias("position"), manifest_link_error(link, F.col("page_count")).alias("error")))
    first = F.filter(F.concat(F.array(F.struct(F.lit(0).alias("position"), manifest_error(fields, F.col("__file"), allow_legacy).alias("error"))), F.coalesce(of_links, F.array().cast("array<struct<position:int,error:string>>"))), lambda e: e["error"].isNotNull())
    return rows.select("doc_id", first.alias("e")).where(F.size("e") > 0).select("doc_id", F.col("e")[0]["position"].alias("position"), F.col("e")[0]["error"].alias("error"))


def report_errors(reports: DataFrame, files: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
    """(doc_id, error): all that a link report gets wrong about its source and output.

    ``reports``: manifest fields plus output_sha256, pages, mode, unresolved_toc_rows, suspected_unparsed_toc_rows and
    the three count maps; ``files``: doc_id, source_file_sha256, output_file_sha256, page_count; ``source`` and
    ``output``: links with 1-based pages and seq.
    """
    counts = lambda rows, name: rows.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{name}_{k}") for k in KINDS])
    rows = reports.join(files, "doc_id").join(counts(source, "src"), "doc_id", "left").join(counts(output, "out"), "doc_id", "left")
    rows = rows.fillna(0, [f"{n}_{k}" for n in ("src", "out") for k in KINDS])
    checks: list[tuple[Column, str]] = [(~F.coalesce(F.col("schema_version") == 2, F.lit(False)), "schema_version must be 2"), (~F.coalesce(F.col("status") == "PASS", F.lit(False)), "status is not PASS")]
    for name, own in (("input_sha256", "source_file_sha256"), ("output_sha256", "output_file_sha256")):
        good = F.coalesce(F.length(name) == 64, F.lit(False))
        checks += [(~good, f"{name} is required and must be a SHA-256 digest"), (good & (F.lower(name) != F.lower(own)), f"{name} does not match its file")]
    checks += [
        (~F.coalesce(F.col("pages") == F.col("page_count"), F.lit(False)), "page count does not match"),
        (F.coalesce(F.size("unresolved_toc_rows") > 0, F.lit(False)), "unresolved contents rows"),
        (F.coalesce(F.col("suspected_unparsed_toc_rows") > 0, F.lit(False)), "suspected unparsed contents rows"),
        *[(F.col(c).isNull(), f"{c} is required") for c in ("existing_links", "added_links", "final_links")],
    ]
    get = lambda c, k: F.coalesce(F.col(c)[k], F.lit(0))
    listed = lambda k: F.size(F.filter("links", lambda x: x["kind"] == k))
    for k in KINDS:
        checks.append((F.col("existing_links").isNotNull() & (get("existing_links", k) != F.col(f"src_{k}")), f"existing {k} count does not match the source"))
        if k != "other":
            checks.append((F.col("added_links").isNotNull() & (get("added_links", k) != listed(k)), f"added {k} count does not match the links"))
        whole = F.col("existing_links").isNotNull() & F.col("added_links").isNotNull() & F.col("final_links").isNotNull()
        checks.append((whole & (get("final_links", k) != get("existing_links", k) + get("added_links", k)), f"final {k} count is inconsistent"))
        checks.append((whole & (get("final_links", k) != F.col(f"out_{k}")), f"final {k} count does not match the output"))
    sure = F.exists("links", lambda x: (x["kind"] == "internal") & ~F.coalesce(x["confidence"].isin("high", "medium"), F.lit(False)))
    checks.append((F.coalesce((F.col("mode") == "automatic-analysis") & sure, F.lit(False)), "an automatic link lacks accepted confidence"))
    checks.append((F.coalesce(F.exists("links", lambda x: x["matched_by"] == "physical-page-fallback"), F.lit(False)), "a link uses a physical page fallback"))
    found = rows.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(text)) for when, text in checks]))).alias("error"))
    reported = reports.select("doc_id", F.posexplode("links").alias("pos", "l")).select("doc_id", (F.coalesce("l.source_page_index", "l.source_page") + 1).alias("source_page"), "l.kind", (F.coalesce("l.target_page_index", "l.target_page") + 1).alias("target_page"), "l.uri", "l.rect", (F.col("pos") + F.lit(1 << 32)).alias("seq"))
    columns = ["doc_id", "source_page", "kind", "target_page", "uri", "rect", "seq"]
    wanted = source.select(*columns).unionByName(reported)
    alone = tolerant_match(wanted, output.select(*columns))
    text = F.when(F.col("side") == "unexpected", "an output link is not accounted for").when(F.col("seq") >= 1 << 32, "a reported link has no matching output link").otherwise("a source link has no matching output link")
    return found.union(alone.select("doc_id", text))
