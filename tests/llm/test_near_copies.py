import random

import corpus_pipeline
from foliant.llm import near_copies
from foliant.llm.near_copies import first_of_groups, near_copy_groups

RND = random.Random(3)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo")]


def corpus():
    docs = []
    for _ in range(25):
        text = [RND.choice(WORDS) for _ in range(RND.randint(40, 150))]
        docs.append(" ".join(text))
        for _ in range(RND.randint(0, 5)):
            text = list(text)
            for i in RND.sample(range(len(text)), RND.randint(1, 3)):
                text[i] = RND.choice(WORDS)
            docs.append(" ".join(text))
    base = [RND.choice(WORDS) for _ in range(120)]
    docs += [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(60)]
    return [*enumerate(docs), (900, docs[0].upper()), (901, None), (902, ""), (903, "one two"), (904, "One  two"), (None, docs[3])]


def brute(docs):
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (sets[i] or sets[j]) and len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) or label[i] == label[j]:
                continue
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    least = {}
    for (k, _), x in zip(docs, label, strict=True):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return {k: least[x] for (k, _), x in zip(docs, label, strict=True) if k is not None}


def test_groups_are_those_of_brute_force(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for small in (near_copies.SMALL, 2):
        monkeypatch.setattr(near_copies, "SMALL", small)
        got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(frame).collect()}
        assert {k: v for k, v in got.items() if k is not None} == want


def test_pipeline_stage_keeps_one_of_near_copies(spark, tmp_path):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame, str(tmp_path)).collect()}
    assert kept == {k for k, v in brute(docs).items() if k == v} | {None}


def test_rows_of_one_id(spark, monkeypatch):
    long = [" ".join(RND.choice(WORDS) for _ in range(50)) for _ in range(3)]
    docs = [(5, long[0]), (5, long[1]), (5, long[0]), (6, long[1].upper()), (7, long[2]), (7, long[2]), (None, long[0]), (None, long[0]), (8, None), (9, ""), (9, long[0])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h1 int").repartition(3)
    want = sorted([(5, long[0]), (5, long[1]), (7, long[2]), (None, long[0]), (None, long[0]), (8, None)], key=repr)
    for sent in (near_copies.SENT, -1):
        monkeypatch.setattr(near_copies, "SENT", sent)
        kept = first_of_groups(frame).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == want and set(kept[0].asDict()) == {"doc_id", "text", "h1"}


def test_rare_shingles_find_what_the_hubs_missed(spark, monkeypatch):
    """Chains: each text is near the next one only, all share buckets with one hub."""
    text = [RND.choice(WORDS) for _ in range(150)]
    docs = [" ".join(text)]
    for i in range(30):
        text = list(text)
        text[5 * i + 1] = RND.choice(WORDS)
        docs.append(" ".join(text))
    rows = list(enumerate(docs))
    monkeypatch.setattr(near_copies, "SMALL", 2)
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_copy_groups(none).count() == 0 and first_of_groups(none).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert {r["component_id"] for r in near_copy_groups(nothing).collect()} == {1}
