"""SimHash near-duplicates, linked through the pigeonring principle.

The 64 bits lie in seven segments on a ring. Two fingerprints that differ in at
most two bits have a start on the ring from which every chain of l segments
differs in at most 2 l / 7 bits: three segments and then five of the next six
exact, with at most one bit apart in the sixth. Those five segments are the
index key (21 keys a fingerprint); a pair is checked along its chain before the
full Hamming distance is taken. A bucket's fingerprints share 45 bits or more,
so it holds at most 2^19 of them however large the corpus is.

Equal fingerprints are one class from the start, so copies are never paired.
Buckets give the links of a spanning forest, not all pairs; no link is lost to
the components.

Defined cases: null text has no words and fingerprint zero, as has empty text; a
very long text is read whole, a slice of its hashes at a time. Documents are
linked by their fingerprints alone: rows that share an id are judged each, and a
row without id links others but can't name a component (a component without any
id has none). An empty table gives an empty one. Columns other than id and text
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, join_hot, slices
from foliant.llm.components import Forest, components

SEGMENTS, DISTANCE = 7, 2
#: Runs up to this length are compared by shifts, longer ones by looking up the few values that may link.
SHIFTED = 2048


def segment_masks() -> list[int]:
    bounds = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def ring_keys() -> list[tuple[int, int]]:
    """(bits that must be equal, bits of which at most one differs) of each start and each spared segment."""
    seg = segment_masks()
    budget = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]
    exact = budget.count(0)  # first segments of the chain that must be equal
    out = []
    for start in range(SEGMENTS):
        ring = [seg[(start + k) % SEGMENTS] for k in range(SEGMENTS)]
        loose = [k for k in range(exact, SEGMENTS) if budget[k] == 1]
        out += [(sum(ring[k] for k in range(SEGMENTS - 1) if k != spared), ring[spared]) for spared in loose]
    return out


def shingle_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of ``width`` words of all texts, their number in each text); a shorter text is one run."""
    digest = xxhash.xxh64_digest
    hashes: list[bytes] = []
    sizes = []
    for t in texts:
        words = (t or "").encode().lower().split()
        if len(words) <= width:
            if words:
                hashes.append(digest(b" ".join(words), 42))
            sizes.append(1 if words else 0)
            continue
        joined = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        a, b = (end - length)[: 1 - width].tolist(), end[width - 1 :].tolist()
        hashes += [digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)]
        sizes.append(len(a))
    return np.frombuffer(b"".join(hashes), ">u8").astype("<u8"), np.array(sizes, np.int64)


def print_hashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers, of hashes as ``shingle_hashes`` gives them."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.zeros((len(sizes), 64), np.int64)
    for at in range(0, len(flat), 1 << 16):
        piece, owner = flat[at : at + (1 << 16)], row[at : at + (1 << 16)]
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts[owner[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_rows(texts: list[str | None], width: int = 3) -> np.ndarray:
    return print_hashes(*shingle_hashes(texts, width))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprint_rows(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def link_runs(start: np.ndarray, fp: np.ndarray, loose: np.ndarray) -> np.ndarray:
    """The label of each row: rows of one run (``start``: index of its first row) that are linked share one."""
    n, forest = len(fp), Forest(len(fp))
    size = np.bincount(start, minlength=n)[start]
    small = size <= SHIFTED
    at = np.flatnonzero(small & (size > 1))
    step = 1
    while len(at):
        at = at[at + step < start[at] + size[at]]
        apart = fp[at] ^ fp[at + step]
        chain = np.bitwise_count(apart & loose[at]) <= 1
        i = at[chain]
        i = i[np.bitwise_count(apart[chain]) <= DISTANCE]
        forest.link(i, i + step)
        step += 1
    for first in np.unique(start[~small]):
        rows = np.arange(first, first + size[first])
        order = rows[np.argsort(fp[rows])]
        held = fp[order]
        free = int(np.bitwise_or.reduce(held ^ held[0]))
        spared = int(loose[first])
        ones = [1 << k for k in range(64) if free >> k & 1]
        flips = ones + [x | y for x in ones for y in ones if x < y and not (x & spared and y & spared)]
        for flip in flips:
            want = held ^ np.uint64(flip)
            found = np.minimum(np.searchsorted(held, want), len(held) - 1)
            ok = held[found] == want
            forest.link(order[ok], order[found[ok]])
    return forest.label


def forest_links(classes: DataFrame) -> DataFrame:
    """``classes`` (fp, distinct) -> links (u, v) between fingerprints that join all within two bits."""
    keys = ring_keys()
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in keys]
    spread = classes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("ring", "mask"))
    spread = spread.select("ring", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    dealt = spread.repartition("ring", "part").sortWithinPartitions("ring", "part")
    spared = np.array([x for _, x in keys], np.uint64)

    def links(ring, fp, part) -> pa.RecordBatch:
        new = np.r_[True, (ring[1:] != ring[:-1]) | (part[1:] != part[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(ring)), 0))
        label = link_runs(start, fp.view(np.uint64), spared[ring])
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[label[at]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            ring, part = rows.column("ring").to_numpy(), rows.column("part").to_numpy()
            same = (ring == ring[-1:]) & (part == part[-1:])
            done = len(ring) - int(same.sum())  # the last run may go on in the next batch
            held = rows.slice(done)
            if done:
                yield links(ring[:done], rows.column("fp").to_numpy()[:done], part[:done])
        if held is not None and held.num_rows:
            yield links(*(held.column(c).to_numpy() for c in ("ring", "fp", "part")))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included)."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    joined = cut(components(forest_links(classes.select("fp"))).withColumnRenamed("id", "fp"))
    # few fingerprints are linked to others; the rest name themselves
    first = classes.join(joined, "fp").groupBy("component").agg(F.min("least").alias("first"))
    named = joined.join(first, "component").select("fp", "first", F.lit(True).alias("linked"))
    found = classes.join(named, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return join_hot(prints, found, "fp", prints.count()).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
