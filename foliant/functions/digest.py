"""Digests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bundle_sha256(path: Column, digest: Column) -> Column:
    """Aggregate: the digest of a set of files, over ``path NUL digest LF`` in the order of paths."""
    ordered = F.array_sort(F.collect_list(F.struct(path.alias("path"), digest.alias("digest"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda f: F.concat(f["path"], F.lit("\0"), f["digest"], F.lit("\n"))), ""), 256)


def canonical_digest(value: Column) -> Column:
    """Digest of a map of strings that does not depend on the order of its keys."""
    entries = F.array_sort(F.map_entries(value))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.coalesce(e["value"], F.lit("\0")), F.lit("\n"))), ""), 256)
