"""Gates before a document is changed: signatures in its form, features that can't be kept.

``documents``: doc_id and what the catalog holds: has_perms, has_collection, has_xfa
(booleans). ``fields``: the form's fields as rows (doc_id, field, parent, signature);
``parent`` is null for a field that the form lists itself, ``signature`` tells that
the field is of the signature kind or holds a signature as its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.materialize import cut


def reachable_fields(fields: DataFrame) -> DataFrame:
    """The ``fields`` that hang on the form, directly or through their parents.

    Every round doubles how far each field has looked up, so a tree of depth n takes
    log2(n) rounds of one join each. Fields whose parent isn't there don't hang on it,
    and neither do those in a circle: they're what is left when no round can help any more.
    """
    known = cut(fields.select("doc_id", "field", F.col("parent").alias("up"), "signature"))
    left = known.where("up is not null").count()
    rounds = max(1, left.bit_length() + 1)
    while left and rounds:
        above = known.select("doc_id", F.col("field").alias("up"), F.col("up").alias("next"), F.lit(True).alias("there"))
        known = cut(known.join(above, ["doc_id", "up"], "left").where("up is null or there").select("doc_id", "field", F.col("next").alias("up"), "signature"))
        left, rounds = known.where("up is not null").count(), rounds - 1
    return known.where("up is null").drop("up")


def has_signature(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, has_signature): by the catalog's permissions, or by a field anywhere in the form."""
    signed = reachable_fields(fields).where("signature").select("doc_id", F.lit(True).alias("signed")).distinct()
    out = documents.join(signed, "doc_id", "left")
    return out.select("doc_id", (F.coalesce("has_perms", F.lit(False)) | F.coalesce("signed", F.lit(False))).alias("has_signature"))


def unsupported_features(documents: DataFrame) -> DataFrame:
    """(doc_id, features): what a document holds that a changed copy would lose; documents without any are left out."""
    marks = F.array_compact(F.array(F.when(F.col("has_collection"), F.lit("PDF portfolio/collection")), F.when(F.col("has_xfa"), F.lit("XFA form"))))
    return documents.select("doc_id", marks.alias("features")).where(F.size("features") > 0)


def refused(documents: DataFrame, fields: DataFrame, allow_signed: bool = False) -> DataFrame:
    """(doc_id, reason): the documents that must not be changed."""
    features = unsupported_features(documents).select("doc_id", F.concat(F.lit("unsupported features: "), F.array_join("features", ", ")).alias("reason"))
    if allow_signed:
        return features
    return features.union(has_signature(documents, fields).where("has_signature").select("doc_id", F.lit("the document is signed")))
