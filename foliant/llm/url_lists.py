"""URL filters over dated lists: a temporal join of captures with list entries.

A list is a table of dated events (kind, pattern, action, at): ``add`` puts a
pattern on the list, ``remove`` takes it off. The events of a pattern become
validity intervals that don't overlap (of events at one time, ``remove`` comes
last). Kinds: ``host`` (this host), ``domain`` (it and all below it), ``prefix``
(host and leading path segments). A capture is turned into the few keys that
could match it and joined on the key, as of its fetch time; since a pattern has
one interval at a time at most, a key gives one row at most.

Equal captures (same URL and time) are evaluated once. The intervals are sent to
the executors only if they are few; else both sides are dealt by key, where the
adaptive join splits a hot host.

Defined cases: a null URL, a URL without a host and a null time match nothing.
Ports and user names count on neither side. Events with a null field are ignored.
All rows and columns of the captures stay, also repeated rows; columns named like
the added ones are replaced. Of several active entries the narrowest counts:
prefixes before hosts before domains, longer patterns first. An empty list blocks
nothing, an empty table of captures gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to this number (some 100 bytes each) are sent to all executors.
SENT_INTERVALS = 100_000
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
ADDED = ["host", "blocked", "rule_kind", "rule", "listed_since"]


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def validity(events: DataFrame) -> DataFrame:
    """(kind, pattern, since, until) of every time a pattern was on the list; ``until`` is null for the present."""
    bare = F.regexp_replace(F.col("pattern"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(bare, r"^(?:[^/@]*@)?([^/:]*)", 1)), F.regexp_extract(bare, r"^[^/]*(.*?)/*$", 1)
    rows = events.select("kind", F.when(F.col("kind") == "prefix", F.concat(host, path)).otherwise(host).alias("pattern"), "action", F.col("at").cast("timestamp").alias("at"))
    rows = rows.where("kind in ('host', 'domain', 'prefix') and pattern <> '' and action in ('add', 'remove') and at is not null")
    rows = rows.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action"))
    history = Window.partitionBy("kind", "pattern").orderBy("at")
    return rows.select("kind", "pattern", "action", F.col("at").alias("since"), F.lead("at").over(history).alias("until")).where("action = 'add'").drop("action")


def capture_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Array of (kind, pattern) that could match: domains of at most ``labels`` labels, prefixes of at most ``depth`` segments."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, n - k + 1, k), ".").alias("pattern")))
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(depth))), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")).alias("pattern")))
    hosts = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")), F.struct(F.lit("prefix").alias("kind"), host.alias("pattern")))
    return F.concat(hosts, domains, prefixes)


def filter_urls(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` plus host, blocked, and the kind, pattern and start of the narrowest entry active at fetch time."""
    captures = captures.drop(*ADDED)
    listed = validity(events)
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("pattern", r"\."))), F.lit(1)).alias("labels"), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(1)).alias("depth")).first()
    if size["n"] <= SENT_INTERVALS:
        listed = F.broadcast(listed)
    when = F.col(time_col).cast("timestamp")
    each = captures.select(F.col(url_col).alias("__url"), when.alias("__at")).where("__url is not null and __at is not null").distinct()
    each = each.withColumn("host", url_host(F.col("__url"))).where("host <> ''")
    keyed = each.select("__url", "__at", F.inline(F.array_distinct(capture_keys(F.col("host"), F.regexp_extract("__url", URL, 2), size["labels"], max(1, size["depth"])))))
    hits = keyed.join(listed, ["kind", "pattern"]).where("__at >= since and (until is null or __at < until)")
    rank = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    best = hits.groupBy("__url", "__at").agg(F.max(F.struct(rank.alias("rank"), F.length("pattern").alias("length"), "kind", "pattern", "since")).alias("best"))
    joined = captures.join(best, (captures[url_col] == best["__url"]) & (when == best["__at"]), "left")
    return joined.select(*captures.columns, F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"), F.col("best").isNotNull().alias("blocked"), F.col("best.kind").alias("rule_kind"), F.col("best.pattern").alias("rule"), F.col("best.since").alias("listed_since"))
