"""Near copies: documents that share 0.8 or more of their five-word shingles, for the pipeline's SimHash stage.

Candidates come from two sources and all are confirmed by the exact similarity
of the sets of shingles:

* SimHash fingerprints within two bits, found by pigeonring (``simhash``). Two
  bits hold near copies of a few changed words in long texts only: texts of
  similarity 0.8 differ in about ten of 64 bits, which no pigeonring index finds
  without looking at most pairs;
* so, for the rest, ``BANDS`` keys of ``ROWS`` MinHash minima. Classes of Jaccard
  similarity s share one with probability 1 - (1 - s^ROWS)^BANDS: 0.99997 at 0.8.

Texts of the same words are one class from the start, so copies are never paired.
In a bucket of up to ``SMALL`` classes all pairs are compared; in a larger one,
every class with its hub, the class that meets most others over all buckets (the
original of a group of edited copies). Where a large bucket's classes don't all
go by one hub then, they are compared by the rarest of their shingles: two sets
that reach the similarity share one of them at places that leave room for the rest
of the overlap, so pairs that can't reach it are never formed. This way is exact,
and needs no second look at the members that one hub has joined.

Defined cases: null and empty texts are one class that links with no other; a
text of under five words is one shingle. Rows that share an id are judged each by
their text. Rows without id link others, but name nothing. An empty table gives
an empty one. Columns other than id and text play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import HOT, SENT_KEYS, cut, join_hot, release, slices
from foliant.llm.components import components
from foliant.llm.simhash import forest_links, print_hashes, shingle_hashes

BANDS, ROWS, SMALL = 20, 4, 16
#: Ids or classes that are sent to the executors at most; beyond it both sides are dealt by key.
SENT = 200_000
_DRAWN = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def class_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's words, as two numbers."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all texts one after another, number of keys of each text); none for a text without words."""
    some = np.flatnonzero(sizes)
    counts = np.zeros(len(sizes), np.int64)
    if not len(some):
        return np.zeros(0, np.int64), counts
    starts = (np.cumsum(sizes) - sizes)[some]
    least = np.array([np.minimum.reduceat((hashes ^ flip) * factor, starts) for flip, factor in zip(FLIPS, FACTORS, strict=True)]).T.copy()
    counts[some] = BANDS
    keys = [xxhash.xxh3_64_intdigest(minima.tobytes(), k) - (1 << 63) for row in least.reshape(len(some), BANDS, ROWS) for k, minima in enumerate(row)]
    return np.array(keys, np.int64), counts


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sets of shingles (sorted 64-bit numbers) reach the similarity."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def needed(a: Column, b: Column, least: float) -> Column:
    """The overlap that sets of sizes ``a`` and ``b`` need for the similarity."""
    return F.ceil((a + b) * (least / (1 + least)) - 1e-9)


class _Corpus:
    """The rows of a table with their keys, and the shingles of single classes on demand."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int):
        key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.sha2(text_col, 256)), F.lit("#"))
        self.rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
        self.width = width

    def prints(self) -> DataFrame:
        """(id, key, h1, h2, fp, bands): what is known of each row without its text."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    texts = part.column("text").to_pylist()
                    hashes, sizes = shingle_hashes(texts, width)
                    keys, counts = band_keys(hashes, sizes)
                    bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys))
                    h1, h2 = class_of(texts)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(h1), pa.array(h2), pa.array(print_hashes(hashes, sizes).view(np.int64)), bands], names=["id", "key", "h1", "h2", "fp", "bands"])

        kind = self.rows.schema["id"].dataType.simpleString()
        return self.rows.mapInArrow(run, f"id {kind}, key string, h1 long, h2 long, fp long, bands array<long>")

    def shingles(self, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, size, shingles) of some classes (node); only the texts of one row each are read for it."""
        named = cut(classes.join(nodes, "node", "left_semi").select("key", "node", "h1", "h2"))
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    texts = part.column("text").to_pylist()
                    h1, h2 = class_of(texts)
                    own = (h1 == part.column("h1").to_numpy()) & (h2 == part.column("h2").to_numpy())  # another row of that id has another text
                    hashes, sizes = shingle_hashes(texts, width)
                    sets = [np.unique(x) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
                    made = pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "size", "shingles"])
                    yield made.filter(pa.array(own))

        few = F.broadcast(named) if named.count() <= SENT else named
        return cut(self.rows.select("key", "text").join(few, "key").mapInArrow(run, "node long, size int, shingles binary").dropDuplicates(["node"]))


def _confirmed(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``edges`` (u, v: classes) whose similarity is ``least`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c) for c in ("a", "b"))
            ok = pa.array([similar(a[i].as_py(), b[i].as_py(), least) for i in range(batch.num_rows)], pa.bool_())
            yield batch.select(["u", "v"]).filter(ok)

    side = lambda k, c: sets.select(F.col("node").alias(k), F.col("shingles").alias(c))
    return cut(edges.join(side("u", "a"), "u").join(side("v", "b"), "v").mapInArrow(compare, "u long, v long"))


def _bucket_edges(held: DataFrame, total: int) -> DataFrame:
    """``held`` (key, node, n) -> pairs to compare: all of a small bucket, those with the hub in a large one."""
    small = held.where(F.col("n") <= SMALL)
    pairs = small.select("key", F.col("node").alias("u")).join(small.select("key", F.col("node").alias("v")), "key").where("u > v").select("u", "v")
    large = held.where(F.col("n") > SMALL)
    met = held.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = large.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("hub"), F.first("n").alias("n"))
    stars = join_hot(large.drop("n"), hubs, "key", total).where("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
    return pairs.union(stars).distinct()


def _rare_pairs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of ``members`` (node, component) of different components that may reach the similarity, by their rarest shingles."""

    held = cut(members.join(sets, "node"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles"):
                shingle, n = np.unique(np.frombuffer(b"".join(part.column("shingles").to_pylist()), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    frequency = cut(held.select("shingles").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    total = held.agg(F.sum("size")).first()[0] or 0
    # shingles of very many sets are few: they count as equally frequent, and a set tells by itself which it has
    most = max(HOT, -(-total // SENT_KEYS))
    hot = members.sparkSession.sparkContext.broadcast(np.sort(frequency.where(F.col("n") > most).select("shingle").toArrow().column(0).to_numpy()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles"):
                kept, of, known = [np.zeros(0, "<i8")], [], [np.zeros(0, bool)]
                for row, blob in enumerate(part.column("shingles").to_pylist()):
                    own = np.sort(np.frombuffer(blob, "<i8"))
                    often = np.isin(own, hot.value, assume_unique=True)
                    enough = len(own) - math.ceil(len(own) * least - 1e-9) + 1
                    common = own[often][:enough]
                    kept += [own[~often], common]
                    known += [np.zeros(len(own) - int(often.sum()), bool), np.ones(len(common), bool)]
                    of += [row] * (len(own) - int(often.sum()) + len(common))
                rows = part.select(["node", "component", "size"]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(kept)), pa.array(np.concatenate(known))], names=["node", "component", "size", "shingle", "often"])

    each = held.mapInArrow(explode, "node long, component long, size int, shingle long, often boolean")
    rare = each.where("not often").drop("often").join(frequency, "shingle")
    ranked = rare.unionByName(each.where("often").drop("often").withColumn("n", F.lit(most + 1)))
    size = F.col("size")
    enough = size - F.ceil(size * least - 1e-9) + 1  # two sets of the similarity share one of so many of their rarest
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("n", "shingle"))), F.lit(1), F.any_value(enough).cast("int"))
    lists = ranked.groupBy("node", "component", "size").agg(rarest.alias("rarest"))
    listed = cut(lists.select("node", "component", "size", F.posexplode("rarest").alias("place", "one")).select("node", "component", "size", "place", F.col("one.shingle").alias("shingle")))
    mixed = listed.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("shingle", "n")
    left = join_hot(listed, mixed, "shingle", total).drop("n")
    a, b = (left.select("shingle", *(F.col(c).alias(c + x) for c in ("node", "component", "size", "place"))) for x in "12")
    room = F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2")) >= needed(F.col("size1"), F.col("size2"), least)
    return a.join(b, "shingle").where((F.col("component1") != F.col("component2")) & (F.col("node1") > F.col("node2")) & room).select(F.col("node1").alias("u"), F.col("node2").alias("v")).distinct()


def _groups(corpus: _Corpus, least: float) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): every row (id, h1, h2), and every class (h1, h2, n, component) with the component its links give it."""
    prints = cut(corpus.prints())
    classes = prints.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    total = BANDS * classes.count()
    spread = classes.select("node", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = cut(join_hot(spread, buckets, "key", total))
    release(prints)
    # fingerprints: the first class of each stands for it
    worded = classes.where(F.size("bands") > 0)
    owner = cut(worded.groupBy("fp").agg(F.min("node").alias("owner"), F.count("*").alias("n")))
    same = join_hot(worded.select("fp", "node"), owner, "fp", total).where("node <> owner")
    rings = forest_links(owner.select("fp")).join(owner.select(F.col("fp").alias("u"), F.col("owner").alias("ou")), "u").join(owner.select(F.col("fp").alias("v"), F.col("owner").alias("ov")), "v")
    rings = rings.select(F.greatest("ou", "ov").alias("u"), F.least("ou", "ov").alias("v")).union(same.select(F.col("node").alias("u"), F.col("owner").alias("v")))
    edges = cut(_bucket_edges(held, total).union(rings).distinct())
    sets = corpus.shingles(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), classes)
    release(prints)
    links = _confirmed(edges, sets, least)
    # which classes are joined already: a class goes by the linked one that meets most others, its hub as a rule
    met = held.groupBy("node").agg(F.sum("n").alias("met"))
    sides = links.select(F.col("u").alias("of"), F.col("v").alias("node")).union(links.select(F.col("v").alias("of"), F.col("u").alias("node")))
    sides = sides.union(links.select(F.explode(F.array("u", "v")).alias("of")).select("of", F.col("of").alias("node")))
    meets = sides.groupBy("node").agg(F.count("*").alias("n")).join(met, "node", "left")
    parts = join_hot(sides, meets, "node", total).groupBy("of").agg(F.max_by("node", F.struct(F.coalesce("met", F.lit(0)), "node")).alias("part"))
    large = held.where(F.col("n") > SMALL)
    labelled = cut(large.join(parts.withColumnRenamed("of", "node"), "node", "left").select("key", "node", F.coalesce("part", "node").alias("component")))
    split = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    members = cut(join_hot(labelled, split, "key", total).select("node", "component").distinct())
    rest = cut(_rare_pairs(members, sets, least).join(edges, ["u", "v"], "left_anti"))
    release(prints)
    if not rest.isEmpty():
        links = links.union(_confirmed(rest, sets, least))
    joined = components(links).withColumnsRenamed({"id": "node"})
    named = classes.select("node", "h1", "h2", "n").join(joined, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    return prints.select("id", "h1", "h2"), cut(named)


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Per row: id, component_id (smallest id reachable by links of that similarity, itself included)."""
    prints, classes = _groups(_Corpus(docs, id_col, text_col, width), least)
    total = prints.count()
    rows = cut(join_hot(prints, classes, ["h1", "h2"], total).drop("n"))
    first = rows.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    return join_hot(rows, first, "component", total).select(F.col("id").alias(id_col), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, of its rows the one whose words hash lowest.

    Rows without id stay. Rows of one id and different texts are different documents; if they are near copies, one stays.
    """
    prints, classes = _groups(_Corpus(docs, id_col, text_col, width), least)
    total = prints.count()
    rows = cut(join_hot(prints.where("id is not null"), classes, ["h1", "h2"], total).drop("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("id", "h1", "h2")).alias("first"), F.count("*").alias("n"))
    seen = join_hot(rows, first, "component", total)
    own = F.struct("id", "h1", "h2") == F.col("first")
    by_id = cut(seen.groupBy("id").agg(F.count("*").alias("rows"), F.count_if(own).alias("kept")))
    key, text = F.col(id_col), F.col(text_col)
    gone = by_id.where("kept = 0").select(F.col("id").alias("__gone"))
    several = by_id.where("rows > 1 and kept > 0").select(F.col("id").alias("__several"))
    gone, several = (F.broadcast(x) if x.count() <= SENT else x for x in (gone, several))
    rest = docs.join(gone, key == F.col("__gone"), "left_anti")
    once = rest.join(several, key == F.col("__several"), "left_anti")
    # rows of an id that has several: the texts decide, and of equal rows one
    kept = seen.where(own).select(F.col("id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    again = rest.join(several, key == F.col("__several"), "left_semi")
    names = again.columns

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                h1, h2 = class_of(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h1), pa.array(h2)], names=[*names, "__own1", "__own2"])

    hashed = again.mapInArrow(marked, T.StructType(list(again.schema.fields)).add("__own1", T.LongType()).add("__own2", T.LongType()))
    chosen = hashed.join(kept, (hashed[id_col] == kept["__id"]) & (hashed["__own1"] == kept["__h1"]) & (hashed["__own2"] == kept["__h2"]), "left_semi")
    return once.unionByName(chosen.dropDuplicates([id_col, "__own1", "__own2"]).drop("__own1", "__own2")).select(*docs.columns)
