"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c >= t lie within e = sqrt(2 - 2 t) of each other, and
so do their projections on any orthonormal basis. Vectors are projected on the
leading principal dimensions, put into grid cells of side e, sorted by the
cells in lexicographic order (range partitioning) and packed into blocks: one
row of bounded size each, with its bounding box.

The sorted sequence is joined with itself recursively. Blocks that follow each
other form runs, runs form larger intervals, and so on up to one for the whole
sequence, each with its bounding box. From the top down, a pair of intervals whose
boxes lie within e is replaced by the pairs of their parts; provably distant pairs
are left out with all that is below them. A pair of runs is halved on in one task,
down to pairs of blocks; a pair of blocks likewise, with cosines in double
precision at the leaves. Those within 1e-9 of the threshold are computed again by
exact sums.

Equal vectors of one label are one class with a size, so copies are never
paired. A pair of blocks gives at most a count and a forest link per class:
no link is lost to the counts or to the components, none is listed.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, rows with a null label and rows with a null id link with nothing; such
a row is a component of its own. Vectors of different length never link. Rows
count each, also those of equal vectors or ids; rows that share an id are judged
each. Ids may be of any type that sorts. An empty table gives an empty one;
columns other than id, vector and label are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import cut, join_hot
from foliant.llm.components import Forest, components

#: Bytes of the vectors of a block; dimensions of the grid; rows of a leaf of the recursion.
BLOCK_BYTES, GRID, LEAF = 2 << 20, 8, 128
#: Bits of the number of blocks in a run, whose boxes one row holds; bits of the number of parts of a larger interval.
RUN, FAN = 11, 5
#: Widest length that gets a full second moment; cells of all second moments together, which the driver sums.
WIDEST, CELLS = 256, 1 << 21
#: Cosines this close to the threshold are computed again, exactly.
CLOSE = 1e-9
BLOCK_ROWS = "block long, label {label}, d int, n int, lo array<double>, hi array<double>, nodes binary, sizes binary, vectors binary, grid binary"


def _unit(flat: np.ndarray, d: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, unit vectors) of each length in a batch."""
    col = batch.column("vector")
    length = np.diff(col.offsets.to_numpy())
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield int(d), at, _unit(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), int(d))


def _sketch(d: int, widest: int) -> np.ndarray:
    """Orthonormal columns in which the principal dimensions are looked for: all of them unless there are too many."""
    if d <= widest:
        return np.eye(d)
    return np.linalg.qr(np.random.default_rng(7).standard_normal((d, widest)))[0]


def principal_bases(classes: DataFrame, grid: int) -> dict[int, np.ndarray]:
    """For each length, the leading directions of all vectors' second moment. Many lengths share the bound on what is collected."""
    lengths = classes.select(F.size("vector")).distinct().count()
    widest = max(1, min(WIDEST, math.isqrt(CELLS // max(1, lengths))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                y = x @ _sketch(d, widest)
                total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["d", "cell", "v"])

    sums = classes.select("vector").mapInArrow(run, "d int, cell int, v double").groupBy("d", "cell").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in sums.groupby("d"):
        w = min(int(d), widest)
        m = np.zeros(w * w)
        m[part["cell"].to_numpy()] = part["v"].to_numpy()
        out[int(d)] = _sketch(int(d), widest) @ np.linalg.eigh(m.reshape(w, w))[1][:, ::-1][:, :grid]
    return out


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.tolist(), b.tolist()
    dot = lambda x, y: math.fsum(map(mul, x, y))
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def _boxes_apart(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def join_intervals(xa, ya, xb, yb, threshold: float, reach2: float, same: bool, raw: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of two sorted intervals with cosine >= threshold (i < j if both are one interval).

    ``raw``: the vectors before they were scaled, for cosines close to the threshold.
    """
    ra, rb = raw or (xa, xb)
    out_i, out_j = [], []
    work = [(0, len(xa), 0, len(xb))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if same and b1 <= a0 + 1:
            continue
        ya_, yb_ = ya[a0:a1], yb[b0:b1]
        if _boxes_apart(ya_.min(0), ya_.max(0), yb_.min(0), yb_.max(0)) > reach2:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            cosine = xa[a0:a1] @ xb[b0:b1].T
            i, j = np.nonzero(cosine >= threshold - CLOSE)
            near = cosine[i, j] < threshold + CLOSE
            i, j = i + a0, j + b0
            if near.any():
                far = [k for k in np.flatnonzero(near).tolist() if exact_cosine(ra[i[k]], rb[j[k]]) < threshold]
                i, j = np.delete(i, far), np.delete(j, far)
            if same:
                i, j = i[i < j], j[i < j]
            out_i.append(i)
            out_j.append(j)
            continue
        am = [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)] if a1 - a0 > LEAF else [(a0, a1)]
        bm = [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > LEAF else [(b0, b1)]
        work += [(*p, *q) for p in am for q in bm]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def near_boxes(lo_a, hi_a, lo_b, hi_b, reach2: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of boxes of two sequences that lie within reach: intervals are halved, distant ones left out."""
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    work = [(0, len(lo_a), 0, len(lo_b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        la, ha, lb, hb = lo_a[a0:a1], hi_a[a0:a1], lo_b[b0:b1], hi_b[b0:b1]
        if _boxes_apart(la.min(0), ha.max(0), lb.min(0), hb.max(0)) > reach2:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            gap = np.maximum(0, np.maximum(la[:, None] - hb, lb - ha[:, None]))
            i, j = np.nonzero((gap * gap).sum(2) <= reach2)
            out_i.append(i + a0)
            out_j.append(j + b0)
            continue
        am = [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)] if a1 - a0 > LEAF else [(a0, a1)]
        bm = [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > LEAF else [(b0, b1)]
        work += [(*p, *q) for p in am for q in bm]
    return np.concatenate(out_i), np.concatenate(out_j)


def near_blocks(blocks: DataFrame, grid: int, reach2: float, last: int) -> DataFrame:
    """(a, b, d): the pairs of blocks (a <= b) whose boxes lie within reach, by recursion over intervals of the sequence.

    ``last``: the largest block number.
    """
    lo, hi = [f"lo{k}" for k in range(grid)], [f"hi{k}" for k in range(grid)]
    edges = [*[F.get("lo", F.lit(k)).alias(lo[k]) for k in range(grid)], *[F.get("hi", F.lit(k)).alias(hi[k]) for k in range(grid)]]
    ends = [F.min(c).alias(c) for c in lo] + [F.max(c).alias(c) for c in hi]
    box = blocks.select("label", "d", F.shiftright("block", RUN).alias("at"), F.struct("block", "lo", "hi").alias("box"), *edges)
    levels = [box.groupBy("label", "d", "at").agg(F.collect_list("box").alias("boxes"), *ends)]  # 2^RUN boxes at most
    bits = last.bit_length() - RUN
    while bits > 0:
        above = levels[-1].withColumn("at", F.shiftright("at", FAN))
        levels.append(above.groupBy("label", "d", "at").agg(*ends))
        bits -= FAN
    levels = [cut(x) for x in levels]
    pairs = levels[-1].select("label", "d", F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda s, level=level: level.select("label", "d", F.col("at").alias(s), F.shiftright("at", FAN).alias(f"up_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in lo + hi])
        parts = pairs.withColumnsRenamed({"a": "up_a", "b": "up_b"}).join(side("a"), ["label", "d", "up_a"]).join(side("b"), ["label", "d", "up_b"])
        gaps = [F.greatest(F.col(f"lo{k}_a") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}_a"), F.lit(0.0)) for k in range(grid)]  # shorter vectors have fewer dimensions
        near = reduce(lambda x, y: x + y, (g * g for g in gaps)) <= reach2
        pairs = parts.where((F.col("a") <= F.col("b")) & near).select("label", "d", "a", "b")
    boxes = lambda s: levels[0].select("label", "d", F.col("at").alias(s), F.col("boxes").alias(f"boxes_{s}"))
    runs = pairs.join(boxes("a"), ["label", "d", "a"]).join(boxes("b"), ["label", "d", "b"]).select("d", "boxes_a", "boxes_b")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for name in ("boxes_a", "boxes_b"):
                    held = batch.column(name)[row].values
                    order = pc.sort_indices(held.field("block"))
                    number = held.field("block").take(order).to_numpy()
                    shape = (len(number), -1)
                    low, high = (held.field(c).take(order).flatten().to_numpy().reshape(shape) for c in ("lo", "hi"))
                    sides.append((number, low, high))
                (na, la, ha), (nb, lb, hb) = sides
                i, j = near_boxes(la, ha, lb, hb, reach2)
                a, b = na[i], nb[j]
                own = a <= b
                yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own]), pa.array(np.full(int(own.sum()), batch.column("d")[row].as_py(), np.int32))], names=["a", "b", "d"])

    return runs.mapInArrow(inside, "a long, b long, d int")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, grid: int = GRID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_links, component_id (smallest id reachable, itself included), kept."""
    spark = vectors.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6  # room for rounding; leaves are exact
    v = F.col("vector")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("fine", fine).withColumns({"h": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "label", "vector")})
    good = rows.where("fine")
    classes = good.groupBy("h", "h2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    bases = spark.sparkContext.broadcast(principal_bases(classes, grid))
    label_type = rows.schema["label"].dataType.simpleString()
    element = rows.schema["vector"].dataType.elementType
    kept_as, wide = (np.float32, 4) if isinstance(element, T.FloatType) else (np.float64, 8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch):
                y = x @ bases.value[d]
                cells = (np.floor(y / reach).astype(np.int64) + (1 << 31)).astype(">u4")
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), d, np.int32)), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([c.tobytes() for c in y], pa.binary())], names=[*part.schema.names, "d", "ego", "y"])

    spare = classes.select("node", "size", "label", "vector")
    placed = spare.mapInArrow(place, T.StructType(list(spare.schema.fields)).add("d", T.IntegerType()).add("ego", T.BinaryType()).add("y", T.BinaryType()))
    order = ["label", "d", "ego", "node"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, None

        def row(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            t = t.combine_chunks()
            y = np.frombuffer(b"".join(t.column("y").to_pylist()), np.float64).reshape(t.num_rows, -1)
            flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kept_as)
            number += 1
            blob = lambda x: [np.ascontiguousarray(x).tobytes()]
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                    "label": t.column("label").slice(0, 1).combine_chunks(),
                    "d": t.column("d").slice(0, 1).combine_chunks(),
                    "n": pa.array([t.num_rows], pa.int32()),
                    "lo": pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
                    "hi": pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
                    "nodes": blob(t.column("node").to_numpy()),
                    "sizes": blob(t.column("size").to_numpy()),
                    "vectors": blob(flat),
                    "grid": blob(y.astype(np.float32)),
                }
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            while held.num_rows:
                d = held.column("d")[0].as_py()
                block = max(16, block_bytes // (d * wide))
                head = held.slice(0, block)
                same = pc.and_(pc.equal(head.column("label"), head.column("label")[0]), pc.equal(head.column("d"), d))
                first = pc.index(same, False).as_py()
                first = head.num_rows if first < 0 else max(1, first)
                if first == held.num_rows and first < block:
                    break  # the block may go on in the next batch
                yield row(held.slice(0, first))
                held = held.slice(first)
        if held is not None and held.num_rows:
            yield row(held)

    blocks = cut(dealt.mapInArrow(pack, BLOCK_ROWS.format(label=label_type)))
    # numbers without gaps between the partitions' blocks, so that intervals of the sequence fill up
    low = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    most = blocks.agg(F.max(low).alias("n"), F.max(F.shiftright("block", 32)).alias("part")).first()
    shift = (most["n"] or 0).bit_length()
    blocks = blocks.withColumn("block", F.shiftleft(F.shiftright("block", 32), shift) + low)
    pairs = near_blocks(blocks, grid, reach * reach, ((most["part"] or 0) + 1) << shift)
    held = ["n", "nodes", "sizes", "vectors", "grid"]
    side = lambda k: blocks.select(F.col("block").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in held])
    # a block has far fewer pairs than there are blocks, so no key is hot; splitting one would only read its block again
    work = pairs.repartition("a").join(side("a").repartition("a"), "a").repartition("b").join(side("b").repartition("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, k=k, batch=batch: batch.column(c)[k].as_py()
                d, same = get("d"), get("a") == get("b")
                raw = {s: np.frombuffer(get(f"vectors_{s}"), kept_as).astype(np.float64).reshape(-1, d) for s in "ab"}
                x = {s: _unit(raw[s], d) for s in "ab"}
                y = {s: np.frombuffer(get(f"grid_{s}"), np.float32).reshape(get(f"n_{s}"), -1) for s in "ab"}
                node, size = ({s: np.frombuffer(get(f"{c}_{s}"), np.int64) for s in "ab"} for c in ("nodes", "sizes"))
                i, j = join_intervals(x["a"], y["a"], x["b"], y["b"], threshold, reach * reach, same, (raw["a"], raw["b"]))
                if not len(i):
                    continue
                jj = j if same else j + len(node["a"])
                nodes = node["a"] if same else np.concatenate([node["a"], node["b"]])
                sizes = size["a"] if same else np.concatenate([size["a"], size["b"]])
                count = np.bincount(i, sizes[jj], len(nodes)) + np.bincount(jj, sizes[i], len(nodes))
                forest = Forest(len(nodes))
                forest.link(i, jj)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(count[at].astype(np.int64)), pa.array(nodes[forest.label[at]])], names=["node", "links", "other"])

    found = cut(work.mapInArrow(compare, "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "node")
    out = classes.select("h", "h2", "node", "least", "size").join(links, "node", "left").join(joined, "node", "left")
    out = cut(out.select("h", "h2", "least", "size", "links", F.coalesce("component", "node").alias("component")))
    first = out.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    out = join_hot(out, first, "component", out.count())
    out = out.select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("first").alias("component_id"), F.col("size").alias("n"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    linked = join_hot(good.select("id", "h", "h2"), out, ["h", "h2"], total).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
