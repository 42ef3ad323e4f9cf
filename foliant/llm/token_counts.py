"""Token counts of whole texts under a byte-level BPE vocabulary.

Rank-synchronous merging: the distinct pre-tokens of a slice of rows lie one
after another in flat numpy arrays. In every round each sequence finds its own
lowest-ranked adjacent pair and applies it everywhere at once; sequences with
no pair left are counted and leave the arrays. No row is shuffled.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each
for itself. An empty table gives an empty result. Columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import slices

#: Pre-token pattern of the byte-level family (a fixed value of the vocabulary format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int32(2**31 - 1)
#: Pre-tokens whose counts a worker remembers between slices; beyond this it forgets all and starts again.
REMEMBERED = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256 onward."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


@dataclass
class MergeTable:
    """Merges as sorted pair keys; size is that of the vocabulary file, so it may be sent to all executors."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray  # by rank
    byte_ranks: np.ndarray  # rank of a pair of two bytes, by 256 * first + second
    specials: tuple[str, ...]

    @classmethod
    def read(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        ids = np.array([vocab[c] for c in byte_symbols()], np.int32)
        out = cls(ids, keys[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32), np.empty(0, np.int32), tuple(t["content"] for t in spec.get("added_tokens", ())))
        out.byte_ranks = out.rank_of(np.repeat(ids, 256), np.tile(ids, 256))
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word (words must not be empty)."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        seq, sym = np.arange(len(words)), self.byte_ids[raw]
        last = np.zeros(len(raw), bool)
        last[np.cumsum(length) - 1] = True
        rank = np.full(len(raw), NO_RANK)
        rank[:-1] = self.byte_ranks[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        rank[last] = NO_RANK
        while True:
            starts = np.cumsum(length) - length
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < NO_RANK
            if not going.all():
                out[seq[~going]] = length[~going]
                if not going.any():
                    return out
                held = np.repeat(going, length)
                sym, rank, last = sym[held], rank[held], last[held]
                seq, length, lowest = seq[going], length[going], lowest[going]
            owner = np.repeat(np.arange(len(seq)), length)
            hit = rank == lowest[owner]
            # a run of hits is one symbol repeated: every other hit merges, from the left
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) > 1
            first = at[fresh][np.cumsum(fresh) - 1]
            at = at[(at - first) % 2 == 0]
            sym[at] = self.results[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            length = length - np.bincount(owner[at], minlength=len(seq))
            moved = at - np.arange(len(at))  # places of the merged symbols once the others are gone
            sym, rank, last = sym[keep], rank[keep], last[keep]
            rank[moved] = NO_RANK
            after = moved[~last[moved]]
            rank[after] = self.rank_of(sym[after], sym[after + 1])
            before = moved[moved > 0] - 1
            before = before[~last[before]]
            rank[before] = self.rank_of(sym[before], sym[before + 1])


def text_counter(table: MergeTable):
    """A function from a list of texts to their numbers of tokens, with a bounded memory of pre-tokens."""
    find = regex.compile(PRE_TOKENS).findall
    special = regex.compile("|".join(map(regex.escape, sorted(table.specials, key=len, reverse=True)))) if table.specials else None
    known: dict[str, int] = {}

    def count(texts: list[str | None]) -> np.ndarray:
        words: list[str] = []
        ends, extra = [], []
        for t in texts:
            n = 0
            if t:
                if special is not None and (parts := special.split(t)) and len(parts) > 1:
                    n = len(parts) - 1
                    for p in parts:
                        words += find(p)
                else:
                    words += find(t)
            ends.append(len(words))
            extra.append(n)
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, table.count([w.encode() for w in new]).tolist()))
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), out=total[1:])
        ends = np.array([0, *ends])
        return total[ends[1:]] - total[ends[:-1]] + np.array(extra, np.int64)

    return count


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. ``vocabulary``: path on the driver of a byte-level BPE JSON."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(MergeTable.read(vocabulary))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
