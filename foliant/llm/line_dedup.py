"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased;
128 bits of its XXH3 stand for it. A ``LineIndex`` has two tables:

* the exact one, which holds for each key in how many documents it occurs;
* a cuckoo filter for each shard of the key space, with the keys that reached
  the threshold, and the few other keys of the exact table that it takes for one
  of them (its exceptions). Filter and exceptions together are exact.

Inserting documents adds to the counts and deleting them subtracts; keys that
cross the threshold are put into their filter or taken out of it, so any state
can be taken back. A filter that gets too full is built anew from the counts.

Lines are tested against the filters where the texts lie: up to ``SENT_BYTES``
the filters are sent to the executors and no text moves. Beyond that, the lines'
keys are dealt to the shards (each shard several times, so that a line which a
third of all documents hold is spread), tested there, and the lost ones go back
to their documents by id.

Defined cases: null and empty text are one empty line. Rows that share an id are
one document for the counts, and each row stays a row. A row without id is a
document of its own. An empty table gives an empty table. Columns other than id
and text are carried along; those named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import cut, slices

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Frequent keys of one shard; a shard's filter is made by one task.
SHARD_KEYS = 1_000_000
#: Bytes of filters, and number of repeated ids, that are sent to the executors at most.
SENT_BYTES, SENT_IDS = 64 << 20, 1_000_000
#: Copies of a shard where keys are dealt to the filters.
SPREAD = 32


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; each key has two buckets. Keys are pairs of 64-bit words."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> CuckooFilter:
        """A filter that holds all the keys, doubled until they fit."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(a)) / SLOTS / 0.8))))
        while not (out := cls(buckets)).insert(a, b):
            buckets *= 2
        return out

    def _places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
        fp = (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        fp[fp == 0] = 1
        first = ((a >> np.uint64(17)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp, first, self._other(fp, first)

    def _other(self, fp, place):
        mixed = np.asarray(fp).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return place ^ (mixed.astype(np.int64) & (self.buckets - 1))

    def insert(self, a: np.ndarray, b: np.ndarray) -> bool:
        """False if the filter is too full; it is then to be made anew, larger."""
        fp, first, second = self._places(a, b)
        left = np.arange(len(fp))
        for place in (first, second):
            at = left[np.argsort(place[left], kind="stable")]
            where = place[at]
            new = np.ones(len(at), bool)
            new[1:] = where[1:] != where[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
            slot = (self.table[where] != 0).sum(1) + np.arange(len(at)) - start
            fits = slot < SLOTS
            self.table[where[fits], slot[fits]] = fp[at[fits]]
            left = at[~fits]
        spin = 0
        for i in left.tolist():
            f, place = int(fp[i]), int(first[i])
            for _ in range(500):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = f
                    break
                spin += 1
                f, self.table[place, spin % SLOTS] = int(self.table[place, spin % SLOTS]), f
                place = int(self._other(f, place))
            else:
                return False
        return True

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for f, *places in zip(*self._places(a, b), strict=True):
            for place in places:
                at = np.flatnonzero(self.table[place] == f)
                if len(at):
                    kept = np.delete(self.table[place], at[0])
                    kept = kept[kept != 0]
                    self.table[place, : len(kept)], self.table[place, len(kept) :] = kept, 0
                    break

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fp, first, second = self._places(a, b)
        return (self.table[first] == fp[:, None]).any(1) | (self.table[second] == fp[:, None]).any(1)


class Shard:
    """A filter and its exceptions: tells exactly which keys are frequent, of those that the exact table holds."""

    def __init__(self, buckets: int, cells: bytes, exceptions: bytes | None):
        self.filter = CuckooFilter(buckets, np.frombuffer(cells, np.uint32).reshape(buckets, SLOTS))
        self.exceptions = np.sort(np.frombuffer(exceptions or b"", "V16"))

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit = self.filter.holds(a, b)
        if len(self.exceptions):
            at = np.flatnonzero(hit)
            hit[at] = ~np.isin(np.ascontiguousarray(np.stack([a[at], b[at]], 1)).view("V16").ravel(), self.exceptions)
        return hit


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _hashes(text: str | None, min_chars: int) -> list[bytes]:
    """The 16-byte key of each line; b"" for lines too short to count."""
    keys = [key_of(x) for x in (text or "").encode().split(b"\n")]
    return [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars) else b"" for k in keys]


def _words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _batch(a: np.ndarray, b: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**more, "a": pa.array(np.ascontiguousarray(a)), "b": pa.array(np.ascontiguousarray(b))})


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, a, b): the distinct line keys of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [b"".join(dict.fromkeys(_hashes(t, min_chars))) for t in part.column("text").to_pylist()]
                row = np.repeat(np.arange(len(keys)), [len(x) // 16 for x in keys])
                yield _batch(*_words(b"".join(keys)), id=part.column("id").take(pa.array(row)))

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a long, b long")


def _counted(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(a, b, refs): in how many rows each key occurs, summed where the rows lie before anything moves."""
    rows = docs.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = b"".join(x for t in part.column("text").to_pylist() for x in dict.fromkeys(_hashes(t, min_chars)))
                pair, n = np.unique(np.frombuffer(keys, "V16"), return_counts=True)
                yield _batch(*_words(pair.tobytes()), refs=pa.array(n.astype(np.int64)))

    return rows.mapInArrow(run, "refs long, a long, b long").groupBy("a", "b").agg(F.sum("refs").alias("refs"))


def reference_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(a, b, refs): in how many documents each key occurs; rows that share an id are one document."""
    again = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"))
    n = again.count()
    if n == 0:
        return _counted(docs, id_col, text_col, min_chars)
    again = F.broadcast(again) if n <= SENT_IDS else again
    same = F.col(id_col) == F.col("__again")
    once = _counted(docs.join(again, same, "left_anti"), id_col, text_col, min_chars)
    pairs = line_keys(docs.join(again, same, "left_semi"), id_col, text_col, min_chars).distinct()
    more = pairs.groupBy("a", "b").agg(F.count("*").alias("refs"))
    return once.unionByName(more).groupBy("a", "b").agg(F.sum("refs").alias("refs"))


def change_counts(refs: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The exact table after documents came and went (each given as ``reference_counts``)."""
    for counts, sign in ((inserted, 1), (deleted, -1)):
        if counts is not None:
            refs = refs.unionByName(counts.select("a", "b", (F.col("refs") * sign).alias("refs")))
    return refs.groupBy("a", "b").agg(F.sum("refs").alias("refs")).where("refs > 0")


def _shard(shards: int):
    return F.pmod("a", F.lit(shards)).alias("shard")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, buckets, cells): a cuckoo filter for each shard of the keys (a, b)."""

    def run(rows: pa.Table) -> pa.Table:
        made = CuckooFilter.of(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        return pa.table({"shard": rows.column("shard")[:1], "buckets": [made.buckets], "cells": [made.table.tobytes()]})

    return frequent.select(_shard(shards), "a", "b").groupBy("shard").applyInArrow(run, "shard long, buckets long, cells binary")


def change_filters(filters: DataFrame, shards: int, risen: DataFrame, fallen: DataFrame, frequent: DataFrame) -> DataFrame:
    """The filters after some keys (a, b) reached the threshold and others fell below it.

    A shard whose filter gets too full is built anew from its ``frequent`` keys.
    """

    def run(old: pa.Table, moves: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else moves).column("shard")[0].as_py()
        a, b, up = (moves.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "up"))
        if old.num_rows:
            made = CuckooFilter(n := old.column("buckets")[0].as_py(), np.frombuffer(old.column("cells")[0].as_py(), np.uint32).reshape(n, SLOTS).copy())
        else:
            made = CuckooFilter.of(a[:0], b[:0])
        made.delete(a[~up], b[~up])
        fits = made.insert(a[up], b[up])
        return pa.table({"shard": [shard], "buckets": [made.buckets], "cells": pa.array([made.table.tobytes() if fits else None], pa.binary())})

    moves = risen.select("a", "b", F.lit(True).alias("up")).union(fallen.select("a", "b", F.lit(False)))
    moves = moves.select(_shard(shards), "a", "b", "up")
    old = filters.select("shard", "buckets", "cells")
    new = cut(old.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(run, "shard long, buckets long, cells binary"))
    full = new.where("cells is null").select("shard")
    again = frequent.select(_shard(shards), "a", "b").join(full, "shard", "left_semi")
    return new.where("cells is not null").unionByName(build_filters(again, shards))


def _through_filters(keys: DataFrame, filters: DataFrame, shards: int, spread: int) -> DataFrame:
    """Of ``keys`` (with a and b) those that their shard's filter holds. Keys and filters are dealt by shard and meet there.

    Of every shard there are ``spread`` copies; a task holds one filter at a time.
    """
    heads = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("copy"), F.lit(0).alias("turn"), "buckets", "cells", "exceptions")
    own = [F.col(c) for c in keys.columns]
    rest = keys.select(_shard(shards), F.pmod(F.xxhash64(*own), F.lit(spread)).cast("int").alias("copy"), F.lit(1).alias("turn"), F.struct(*own).alias("key"))
    both = heads.unionByName(rest, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            number = batch.column("shard").to_numpy() * spread + batch.column("copy").to_numpy()
            head = np.flatnonzero(batch.column("turn").to_numpy() == 0)
            key = batch.column("key")
            bounds = sorted({0, *head.tolist(), *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows})
            for start, end in zip(bounds, bounds[1:], strict=False):
                if batch.column("turn")[start].as_py() == 0:
                    shard = Shard(*(batch.column(c)[start].as_py() for c in ("buckets", "cells", "exceptions")))
                    name, start = number[start], start + 1
                if start < end and name == number[start]:
                    part = pa.RecordBatch.from_struct_array(key.slice(start, end - start))
                    yield part.filter(pa.array(shard.holds(*(part.column(c).to_numpy() for c in "ab"))))

    return both.mapInArrow(run, keys.schema)


@dataclass
class LineIndex:
    """The state of incremental line dedup: exact counts (a, b, refs) and filters with their exceptions."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        """The index of a first lot of documents."""
        refs = cut(reference_counts(docs, id_col, text_col, min_chars))
        frequent = refs.where(F.col("refs") >= min_docs)
        shards = -(-frequent.count() // SHARD_KEYS) or 1
        return cls(refs, _excepted(cut(build_filters(frequent, shards)), refs, shards, min_docs), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with more documents; an id that is there already counts again, unless it is deleted first."""
        return self._changed(change_counts(self.refs, inserted=reference_counts(docs, id_col, text_col, self.min_chars)))

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index without documents that were inserted, given as they were then."""
        return self._changed(change_counts(self.refs, deleted=reference_counts(docs, id_col, text_col, self.min_chars)))

    def _changed(self, refs: DataFrame) -> LineIndex:
        refs = cut(refs)
        before, after = (r.where(F.col("refs") >= self.min_docs).select("a", "b") for r in (self.refs, refs))
        risen, fallen = after.join(before, ["a", "b"], "left_anti"), before.join(after, ["a", "b"], "left_anti")
        filters = cut(change_filters(self.filters, self.shards, risen, fallen, after))
        return LineIndex(refs, _excepted(filters, refs, self.shards, self.min_docs), self.shards, self.min_docs, self.min_chars)

    def drop(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with ``text_col`` freed of frequent lines, plus n_lines and n_dropped. The documents have to be in the index."""
        docs = docs.drop("n_lines", "n_dropped")
        size = self.filters.agg(F.sum(F.length("cells") + F.length("exceptions"))).first()[0] or 0
        if size <= SENT_BYTES:
            held = {r["shard"]: (r["buckets"], bytes(r["cells"]), bytes(r["exceptions"])) for r in self.filters.collect()}
            return self._drop_here(docs, text_col, docs.sparkSession.sparkContext.broadcast(held))
        # a row without id goes by its text, so that no group holds more than the lines of an id
        key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.sha2(text_col, 256)), F.lit("#"))
        keyed = docs.withColumn("__foliant_key", key)
        found = _through_filters(line_keys(keyed, "__foliant_key", text_col, self.min_chars), self.filters, self.shards, SPREAD)
        lost = found.groupBy(F.col("id").alias("__foliant_key")).agg(F.collect_set(F.struct("a", "b")).alias("__foliant_lost"))
        joined = keyed.join(lost, "__foliant_key", "left").drop("__foliant_key")
        return self._drop_listed(joined, text_col)

    def _drop_here(self, docs: DataFrame, text_col: str, sent) -> DataFrame:
        shards, min_chars, names = self.shards, self.min_chars, docs.columns
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: Shard(*x) for s, x in sent.value.items()}
            for batch in batches:
                for part in slices(batch, text_col):
                    texts = [t or "" for t in part.column(at).to_pylist()]
                    hashes = [_hashes(t, min_chars) for t in texts]
                    each = [h for row in hashes for h in row]
                    a, b = _words(b"".join(h or bytes(16) for h in each))
                    gone = np.zeros(len(each), bool)
                    shard = a % shards
                    for s, f in filters.items():
                        mine = np.flatnonzero(shard == s)
                        gone[mine] = f.holds(a[mine], b[mine])
                    gone &= np.fromiter(map(bool, each), bool, len(each))
                    yield _without(part, at, texts, np.array([len(h) for h in hashes]), gone, names)

        return docs.mapInArrow(run, _with_counts(docs))

    def _drop_listed(self, rows: DataFrame, text_col: str) -> DataFrame:
        names, min_chars = rows.columns[:-1], self.min_chars
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    texts = [t or "" for t in part.column(at).to_pylist()]
                    hashes = [_hashes(t, min_chars) for t in texts]
                    lost = [{np.array([x["a"], x["b"]], "<i8").tobytes() for x in row or ()} for row in part.column(len(names)).to_pylist()]
                    gone = np.array([h in mine for row, mine in zip(hashes, lost, strict=True) for h in row], bool)
                    yield _without(part.select(names), at, texts, np.array([len(h) for h in hashes]), gone, names)

        return rows.mapInArrow(run, _with_counts(rows.drop("__foliant_lost")))


def _with_counts(rows: DataFrame) -> T.StructType:
    return T.StructType(list(rows.schema.fields)).add("n_lines", T.LongType()).add("n_dropped", T.LongType())


def _without(part: pa.RecordBatch, at: int, texts: list[str], n_lines: np.ndarray, gone: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows without the lines that are gone, and their counts."""
    ends = np.cumsum(n_lines)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
    for row in np.flatnonzero(lost).tolist():
        mine = gone[ends[row] - n_lines[row] : ends[row]]
        texts[row] = "\n".join(x for x, g in zip(texts[row].split("\n"), mine.tolist(), strict=True) if not g)
    columns = list(part.columns)
    columns[at] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines.astype(np.int64)), pa.array(lost.astype(np.int64))], names=[*names, "n_lines", "n_dropped"])


def _excepted(filters: DataFrame, refs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``filters`` with their exceptions: the keys under the threshold that they hold, one in some 10^8."""
    filters = filters.withColumn("exceptions", F.lit(b""))
    rare = refs.where(F.col("refs") < min_docs).select("a", "b")
    size = filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if size <= SENT_BYTES:
        sent = filters.sparkSession.sparkContext.broadcast({r["shard"]: (r["buckets"], bytes(r["cells"]), b"") for r in filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: Shard(*x) for s, x in sent.value.items()}
            for batch in batches:
                a, b = (batch.column(c).to_numpy() for c in "ab")
                shard, hit = a % shards, np.zeros(len(a), bool)
                for s, f in held.items():
                    mine = np.flatnonzero(shard == s)
                    hit[mine] = f.holds(a[mine], b[mine])
                yield batch.filter(pa.array(hit))

        taken = rare.mapInArrow(run, "a long, b long")
    else:
        taken = _through_filters(rare, filters, shards, SPREAD)

    def pack(rows: pa.Table) -> pa.Table:
        pairs = np.stack([rows.column(c).to_numpy() for c in "ab"], 1)
        return pa.table({"shard": rows.column("shard")[:1], "exceptions": [pairs.astype("<i8").tobytes()]})

    packed = taken.select(_shard(shards), "a", "b").groupBy("shard").applyInArrow(pack, "shard long, exceptions binary")
    joined = filters.drop("exceptions").join(packed, "shard", "left")
    return cut(joined.select("shard", "buckets", "cells", F.coalesce("exceptions", F.lit(b"")).alias("exceptions")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text_col`` freed of lines whose key occurs in ``min_docs`` documents or more, plus n_lines and n_dropped."""
    return LineIndex.of(docs, id_col, text_col, min_docs, min_chars).drop(docs, id_col, text_col)
