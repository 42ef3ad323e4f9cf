import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.quality import classify, features, fit, strength

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = classify(docs, labels.where(half)).join(labels.where(~half), "doc_id")
    right = found.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_sites_shrink(spark):
    docs = spark.createDataFrame([(i, "some plain words here", "good" if i < 200 else "bad" if i < 400 else "new", "a" if i % 2 else "b") for i in range(402)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 190 or 390 <= i)) for i in range(400)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    assert len(rows) == 402
    assert rows[0]["p_site"] > 0.9 > 0.5 > rows[300]["p_site"]
    assert 0.4 < rows[401]["p_site"] < 0.6  # a site without labels takes the global share
    assert rows[0]["keep"] and not rows[300]["keep"]


def test_against_brute_force(spark):
    """Posteriors site by site in plain Python, each document without its own label."""
    rnd = random.Random(6)
    sites = [(h, p) for h in ("a", "b", None) for p in ("x", None)]
    rows = [(i, " ".join(rnd.choice(["word", "Other", "12", "..."]) for _ in range(rnd.randint(0, 30))), *rnd.choice(sites)) for i in range(120)]
    given = [(i, int(rnd.random() < (0.8 if rows[i][2] == "a" else 0.3))) for i in rnd.sample(range(120), 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classify(docs, labels).collect()}

    y = dict(given)
    weights = fit(features([rows[i][1] for i in sorted(y)]), np.array([y[i] for i in sorted(y)], float))
    sums = lambda keep: (sum(1.0 for i in y if keep(rows[i])), float(sum(y[i] for i in y if keep(rows[i]))))

    def tightness(groups):  # (n, k, expected mean)
        groups = [g for g in groups if g[0]]
        n = sum(g[0] for g in groups)
        chance, spread = sum(g[0] * g[2] * (1 - g[2]) for g in groups), sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups)
        typical = (n - sum(g[0] ** 2 for g in groups) / n) / (len(groups) - 1)
        between = (spread - (len(groups) - 1) * chance / n) / (typical * (len(groups) - 1))
        return min(max(chance / n / between - 1, 1.0), 1e6) if between > 0 else 1e6

    base = (sum(y.values()) + 1) / (len(y) + 2)
    hosts = {h: sums(lambda r, h=h: r[2] == h) for h in ("a", "b", None)}
    paths = {s: sums(lambda r, s=s: r[2:] == s) for s in sites}
    tight = tightness([(*v, base) for v in hosts.values()])
    inner = tightness([(*v, (hosts[s[0]][1] + tight * base) / (hosts[s[0]][0] + tight)) for s, v in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    for i, text, *site in rows:
        n0, k0 = (1, y[i]) if i in y else (0, 0)
        nh, kh = hosts[site[0]]
        n, k = paths[tuple(site)]
        p_host = (kh - k0 + tight * base) / (nh - n0 + tight)
        p_site = (k - k0 + inner * p_host) / (n - n0 + inner)
        p_doc = 1 / (1 + math.exp(-float(features([text])[0] @ weights)))
        clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(odds(clip(p_doc)) + odds(clip(p_site)) - odds(clip(base)))))
        assert abs(got[i]["p_site"] - p_site) < 1e-9 and abs(got[i]["p_quality"] - want) < 1e-6 and got[i]["keep"] == (got[i]["p_quality"] >= 0.5)


def test_own_label_is_not_seen(spark):
    docs = spark.createDataFrame([(i, "the same words", f"site{i}", "x") for i in range(40)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert len({round(r["p_quality"], 6) for r in classify(docs, labels).collect()}) == 1


def test_strength(spark):
    alike = spark.createDataFrame([(float(n), n / 2) for n in (100, 200, 300)], "n double, k double")
    apart = spark.createDataFrame([(100.0, 1.0), (100.0, 99.0), (100.0, 50.0)], "n double, k double")
    assert strength(alike, 0.5) == 1e6 and strength(apart, 0.5) < 5
    assert strength(alike.where("false"), 0.5) == 100.0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 3.0), (2, "", "s", None, 3.0), (2, "", "s", None, 3.0), (None, "x " * 50_000, "s", "l", 3.0)], "doc_id long, text string, source string, lang string, p_quality double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = classify(docs, none).collect()
    assert len(rows) == 4 and all(abs(r["p_quality"] - 0.5) < 1e-9 for r in rows)
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    assert classify(docs, some).count() == 4
    assert classify(docs.where("false"), some).count() == 0
    assert np.isfinite(features(["", None, "\x00", "é" * 9])).all()
