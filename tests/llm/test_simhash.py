import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.components import components
from foliant.llm.simhash import fingerprint_rows, forest_links, near_duplicates, ring_keys


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(n)) for n in (400, 300, 5, 3)]
    out = [*base, *base, base[0].upper(), None, "", " \t\n", "one", "ONE two", "É é", "a\x0bb\x0cc d"]
    for b in base[:2]:
        for _ in range(12):
            w = b.split()
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append(" ".join(w))
    return out


def test_fingerprints():
    rows = texts()
    assert fingerprint_rows(rows).tolist() == [brute_print(t) for t in rows]


def test_long_text_in_pieces():
    t = " ".join(str(i * i) for i in range(90_000))
    assert fingerprint_rows([t, "x", t]).tolist() == [brute_print(t), brute_print("x"), brute_print(t)]


def test_components_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    prints = {i: brute_print(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = groups(prints, linked)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_ring_keys_find_every_pair_once():
    keys = ring_keys()
    assert len(keys) == 21 and all((64 - m.bit_count()) <= 19 for m, _ in keys)
    for a, b in [(), *itertools.combinations(range(64), 1)] and itertools.combinations(range(64), 2):
        apart = 1 << a | 1 << b
        assert any(not apart & m and (apart & spared).bit_count() <= 1 for m, spared in keys)


def links(spark, fps):
    number = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    classes = spark.createDataFrame([(f,) for f in number], "fp long")
    rows = components(forest_links(classes)).collect()
    first = {}
    for r in rows:
        first[r["component"]] = min(first.get(r["component"], len(fps)), number[r["id"]])
    return {number[r["id"]]: first[r["component"]] for r in rows}


def test_rows_without_id_link_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    rows = [(1, 0), (None, 3), (2, 15), (5, 1 << 40), (5, 255), (6, 255 << 8), (None, 1 << 60 | 1 << 59 | 1 << 58 | 7)]
    docs = spark.createDataFrame(rows, "id long, fp long")
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in near_duplicates(docs).collect()), key=repr)
    want = [(1, 0, 1), (None, 3, 1), (2, 15, 1), (5, 1 << 40, 1), (5, 255, 5), (6, 255 << 8, 6), (None, rows[-1][1], None)]
    assert got == sorted(want, key=repr)


def test_hubs_are_sent(spark, monkeypatch):
    monkeypatch.setattr("foliant.llm.common.HOT", 3)
    rnd = random.Random(8)
    edges = [(0, i) for i in range(1, 200)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(500, i) for i in range(395, 420)]
    want = {i: c for i, c in groups(range(501), edges).items()}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: want[i] for i in got} and {i for e in edges for i in e if e[0] != e[1]} == set(got)


def test_dense_buckets(spark, monkeypatch):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(0, 12), rnd.randint(0, 5))) for _ in range(300)})
    fps += [rnd.getrandbits(64) for _ in range(300)]
    linked = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = {i: c for i, c in groups(range(len(fps)), linked).items() if any(i in x for x in linked)}
    assert links(spark, fps) == want
    monkeypatch.setattr(simhash, "SHIFTED", 8)  # the way for long runs
    start = np.zeros(len(fps), np.int64)
    free = (1 << 12) - 1
    near = np.array(sorted(f for f in fps if (f ^ base) & ~free == 0), np.uint64)
    loose = np.full(len(near), 0b111111, np.uint64)
    label = simhash.link_runs(start[: len(near)], near, loose)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(near)), 2) if (int(near[a]) ^ int(near[b])).bit_count() <= 2 and ((int(near[a]) ^ int(near[b])) & 63).bit_count() <= 1]
    low = groups(range(len(near)), pairs)
    assert [label[a] == label[b] for a, b in itertools.combinations(range(len(near)), 2)] == [low[a] == low[b] for a, b in itertools.combinations(range(len(near)), 2)]


def test_runs_across_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_dense = [1 << i for i in range(20)] + [0]
        assert set(links(spark, test_dense).values()) == {0}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r s t")], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=repr) == [(4, 4), (4, 4), (None, 4), (None, None)]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(7, i) for i in range(100, 400)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1041)}, 7: 7, **{i: 7 for i in range(100, 400)}}
    assert components(spark.createDataFrame([], "u long, v long").select(F.col("u"), "v")).count() == 0
