import hashlib
import random
import re
from collections import Counter

import numpy as np

from foliant.llm.line_dedup import CuckooFilter, LineIndex, Shard, build_filters, change_filters, drop_lines, reference_counts


def brute(rows, min_docs, min_chars=1):
    def key(line):
        line = re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    held = {}
    for n, (i, text) in enumerate(rows):
        held.setdefault(("row", n) if i is None else i, set()).update(k for line in (text or "").split("\n") if len(k := key(line)) >= min_chars)
    count = Counter(k for keys in held.values() for k in keys)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or count[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(docs, **how):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in drop_lines(docs, **how).collect()), key=repr)


def sample_rows():
    rnd = random.Random(5)
    pool = ["Alpha line", " alpha LINE\t", "É", "é", "", "  ", "beta", "beta\r", "Ünïcode", "x" * 50_000]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    rows += [(70, "said ten times")] * 10 + [(71, "said ten times"), (72, "  "), (72, "beta")]
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (7, "beta\nother"), (None, "beta\nalpha line"), (None, "beta")]


def test_against_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for how in ({"min_docs": 10}, {"min_docs": 2}, {"min_docs": 25, "min_chars": 3}):
        assert got(docs, **how) == brute(rows, how["min_docs"], how.get("min_chars", 1))


def test_keys_are_dealt_to_filters_that_are_not_sent(spark, monkeypatch):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr("foliant.llm.line_dedup.SENT_BYTES", -1)
    monkeypatch.setattr("foliant.llm.line_dedup.SHARD_KEYS", 2)
    for how in ({"min_docs": 10}, {"min_docs": 3}, {"min_docs": 25, "min_chars": 3}, {"min_docs": 1000}):
        assert got(docs, **how) == brute(rows, how["min_docs"], how.get("min_chars", 1))


def test_repeated_ids_are_joined_if_they_are_many(spark, monkeypatch):
    monkeypatch.setattr("foliant.llm.line_dedup.SENT_IDS", -1)
    rows = sample_rows()
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10) == brute(rows, 10)


def test_ten_rows_of_one_id_are_one_document(spark):
    rows = [(1, "same line")] * 10 + [(2, "same line")]
    assert {r["n_dropped"] for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    rows = [(None, "same line")] * 9 + [(2, "same line")]
    assert {r["n_dropped"] for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_exceptions_are_kept(spark, monkeypatch):
    real = CuckooFilter.holds
    monkeypatch.setattr(CuckooFilter, "holds", lambda self, a, b: real(self, a, b) | (b % 3 == 0))
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    refs = reference_counts(docs).collect()
    held = Shard(4, bytes(64), b"".join(np.array([r["a"], r["b"]], "<i8").tobytes() for r in refs))
    a, b = (np.array([r[c] for r in refs]) for c in "ab")
    assert not held.holds(a, b).any()


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr("foliant.llm.line_dedup.SHARD_KEYS", 2)
    rows = sample_rows()
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3) == brute(rows, 3)


def test_empty_table_and_clashing_columns(spark):
    assert drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(i, "a\nb", "kept", 5) for i in range(10)], "doc_id long, text string, lost string, n_lines int")
    rows = drop_lines(docs).collect()
    assert {(r["lost"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows} == {("kept", 2, 2, "")}
    assert {hashlib.sha256(r["text"].encode()).hexdigest() for r in rows} == {hashlib.sha256(b"").hexdigest()}


def test_index_is_reversible(spark, monkeypatch):
    rows = sample_rows()
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = lambda index: {(r["a"], r["b"]): r["refs"] for r in index.refs.collect()}
    same = lambda index, rows: sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in index.drop(frame(rows)).collect()), key=repr) == brute(rows, 10)
    head = [r for r in rows[:30] if r[0] not in {x[0] for x in rows[30:]}]
    tail = [r for r in rows if r not in head]
    first = LineIndex.of(frame(head))
    both = first.insert(frame(tail))
    assert same(both, head + tail)
    back = both.delete(frame(tail))
    assert state(back) == state(first) and same(back, head)
    assert state(back.insert(frame(tail))) == state(both)
    none = back.delete(frame(head))
    assert state(none) == {} and same(none.insert(frame(head)), head)


def test_a_full_filter_is_built_anew(spark):
    keys = spark.range(40_000).selectExpr("xxhash64(id) as a", "xxhash64(id, 1) as b", "id")
    few = build_filters(keys.where("id < 10"), 3)
    new = change_filters(few, 3, keys.where("id >= 10"), keys.where("id < 5"), keys.where("id >= 5"))
    tables = {r["shard"]: CuckooFilter(r["buckets"], np.frombuffer(bytes(r["cells"]), np.uint32).reshape(-1, 4)) for r in new.collect()}
    held = keys.where("id >= 5").toPandas()
    a, b = held["a"].to_numpy(), held["b"].to_numpy()
    for s, f in tables.items():
        assert f.holds(a[a % 3 == s], b[a % 3 == s]).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    made = CuckooFilter.of(a[:10_000], b[:10_000])
    assert made.holds(a[:10_000], b[:10_000]).all()
    assert made.holds(a[10_000:], b[10_000:]).mean() < 0.01
    made.delete(a[:5_000], b[:5_000])
    assert made.holds(a[5_000:10_000], b[5_000:10_000]).all()
    assert made.holds(a[:5_000], b[:5_000]).mean() < 0.01


def test_filters_follow_the_threshold(spark):
    keys = spark.range(200).selectExpr("xxhash64(id) as a", "xxhash64(id, 1) as b", "id")
    old = build_filters(keys.where("id < 100"), 3)
    new = change_filters(old, 3, keys.where("id >= 150"), keys.where("id < 50"), keys.where("id >= 50 and id < 100 or id >= 150"))
    tables = {r["shard"]: CuckooFilter(r["buckets"], np.frombuffer(bytes(r["cells"]), np.uint32).reshape(-1, 4)) for r in new.collect()}
    for r in keys.collect():
        known = bool(tables[r["a"] % 3].holds(np.array([r["a"]]), np.array([r["b"]]))[0])
        if 50 <= r["id"] < 100 or r["id"] >= 150:
            assert known
