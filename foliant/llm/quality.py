"""Quality classifier with hierarchical empirical Bayes over sites.

Three kinds of evidence on whether a document is good:

* a logistic regression on surface features of the whole text, fitted on at most
  ``max_fit`` labelled documents (a documented bound, drawn by a hash of the id);
* the share of good documents among all labelled ones of its host, shrunk to
  the global share;
* the share of its path (host and section), shrunk to its host's posterior.

The strengths of both shrinkages are estimated from the spread between sites
by the method of moments, in grouped aggregation. The posterior log odds are
the document's plus the path's minus the global ones.

A document's own labels are taken out of its site's sums before its posterior is
made, so a labelled document is judged as if it were not (but for the weights of
the regression and the strengths, which single labels hardly move).

Only a site's sums move; a site with a third of all rows is summed where its
rows lie. Defined cases: null text counts as empty, null hosts and paths are sites
of their own, labels that are null or without a document are ignored, and without
labels every posterior is 1/2. Repeated rows are judged each; label rows count
each. An empty table gives an empty one. Columns other than id, text, host and
path are left out, whatever their names. There are no ties: a posterior of just
the threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, slices

FEATURES = ["one", "log_length", "upper", "digit", "punctuation", "beyond_ascii", "space", "word_length", "distinct_words", "bare_words", "line_length", "distinct_lines", "longest_word"]
EDGE = 1e-4


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 3, np.int64)  # punctuation and control
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = 0, 1, 2, 4
    kinds[[9, 10, 11, 12, 13, 32]] = 5
    return kinds


KINDS = _byte_classes()


def features(texts: list[str | None]) -> np.ndarray:
    """Surface features of each text, one row each, all finite."""
    raw = [(t or "").encode() for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    kinds = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(raw)) * 6, size) + kinds, minlength=6 * len(raw)).reshape(-1, 6)
    share = counts / np.maximum(size, 1)[:, None]
    more = []
    for x in raw:
        words, lines = x.split(), x.split(b"\n")
        n = max(1, len(words))
        bare = sum(map(bytes.isalpha, words))
        more.append((len(x) / n, len(set(words)) / n, bare / n, np.log1p(len(x) / len(lines)), len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0))))
    more = np.array(more, float).reshape(-1, 6)
    more[:, 0] = np.log1p(more[:, 0])
    return np.column_stack([np.ones(len(raw)), np.log1p(size), share[:, 0], share[:, 2], share[:, 3], share[:, 4], share[:, 5], more])


def feature_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text").to_pylist())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], flat], names=["id", "host", "path", "x"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind('id')}, host {kind('host')}, path {kind('path')}, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on raw features, by Newton steps on standardised ones; the first feature is 1."""
    if not len(y):
        return np.zeros(len(FEATURES))
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-9] = 0, 1
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w / scale
    raw[0] = w[0] - (w[1:] * mean[1:] / scale[1:]).sum()
    return raw


def strength(sites: DataFrame, mean: Column | float) -> float:
    """Pseudo-counts of the prior: large if sites (n, k) differ from their expected ``mean`` no more than chance makes them."""
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    r = sites.agg(F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("k") / F.col("n") - mean) ** 2).alias("spread"), F.sum(F.col("n") * mean * (1 - mean)).alias("chance")).first()
    if not r["sites"] or r["sites"] < 2 or not r["chance"]:
        return 100.0
    within = r["chance"] / r["n"]  # m (1 - m)
    typical = (r["n"] - r["nn"] / r["n"]) / (r["sites"] - 1)
    between = (r["spread"] - (r["sites"] - 1) * within) / max(1e-9, typical * (r["sites"] - 1))
    return float(np.clip(within / between - 1, 1.0, 1e6)) if between > 0 else 1e6


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", max_fit: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Per row: id, p_document, p_site, p_quality, keep."""
    rows = cut(feature_rows(docs, id_col, text_col, host_col, path_col))
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    known = cut(rows.join(given, "id"))
    n = known.count()
    share = min(1.0, max_fit / n) if n else 0.0
    drawn = known.where(F.pmod(F.xxhash64(F.col("id"), F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "x", "y")
    drawn = drawn.orderBy("id", "y").limit(2 * max_fit).toPandas()  # max_fit is met on average; the limit holds for ids of very many label rows
    weights = fit(np.array(drawn["x"].tolist(), float).reshape(-1, len(FEATURES)), drawn["y"].to_numpy())

    own = cut(known.groupBy("id", "host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k")))
    path = own.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    host = path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = host.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = (total["k"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    tight = strength(host, base)
    posterior = lambda n, k, prior, weight: (k + weight * prior) / (n + weight)
    whole = host.select(F.col("host").alias("h"), posterior(F.col("n"), F.col("k"), F.lit(base), tight).alias("p_host"))
    inner = strength(path.join(whole, F.col("host").eqNullSafe(F.col("h"))), F.col("p_host"))

    def beside(rows: DataFrame, sums: DataFrame, on: list[str], name: str) -> DataFrame:
        """``rows`` with the sums of their site or their own part of it; 0 where there is none."""
        side = sums.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("n").alias(f"n_{name}"), F.col("k").alias(f"k_{name}"))
        met = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
        out = rows.join(side, reduce(lambda x, y: x & y, met), "left").drop(*[f"__{c}" for c in on])
        return out.fillna(0.0, [f"n_{name}", f"k_{name}"])

    odds = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = rows.select("id", "host", "path", (1 / (1 + F.exp(-odds))).alias("p_document"))
    out = beside(beside(scored, path, ["host", "path"], "path"), host, ["host"], "host")
    out = beside(out, own, ["id", "host", "path"], "own")
    out = beside(out, own.groupBy("id", "host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), ["id", "host"], "own_host")
    p_host = posterior(F.col("n_host") - F.col("n_own_host"), F.col("k_host") - F.col("k_own_host"), F.lit(base), tight)
    out = out.withColumn("p_site", posterior(F.col("n_path") - F.col("n_own"), F.col("k_path") - F.col("k_own"), p_host, inner))
    together = log_odds(F.col("p_document")) + log_odds(F.col("p_site")) - log_odds(F.lit(base))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-together)))
    return out.select(F.col("id").alias(id_col), "p_document", "p_site", "p_quality", (F.col("p_quality") >= threshold).alias("keep"))
