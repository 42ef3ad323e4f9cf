"""Helpers shared by the operators: lineage cuts, joins with hot keys, Arrow batches in bounded slices, lookup tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into objects at once; a longer single text is its own slice.
SLICE_BYTES = 2 << 20
#: Rows of a key from which on it may count as hot; hot keys that are sent to the executors at most.
HOT, SENT_KEYS = 64, 100_000

FREE = np.uint64((1 << 64) - 1)
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Where none is named, a run on this machine alone (tests) gets a temporary one;
    on a cluster that is an error, since its machines don't share such a folder.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do may put off for a whole job.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    trim()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written to the shared one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so later steps neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_hot(rows: DataFrame, info: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` with their key's row of ``info`` (key, n, ...): an inner join; n is the number of the key's rows, ``total`` that of all.

    Keys of very many rows are few, so their part of ``info`` is sent to where the
    rows lie: SENT_KEYS rows at most, as n adds up to ``total``.
    """
    key = [key] if isinstance(key, str) else key
    hot = max(HOT, -(-total // SENT_KEYS))
    sent = F.broadcast(info.where(F.col("n") > hot))
    here = rows.join(sent, key)
    dealt = rows.join(sent.select(*key), key, "left_anti").join(info.where(F.col("n") <= hot), key)
    return here.unionByName(dealt)


def trim() -> None:
    """Give memory that isn't used back to the machine: Python workers stay, and share it with their executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each piece holds at most ``limit`` bytes of ``column`` (one row at least)."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    if col.get_total_buffer_size() <= limit:
        yield batch
        return
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)
    trim()


class Table:
    """Numbers by 64-bit keys, many looked up at a time: open addressing, half full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, FREE, np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = scattered(keys, self.bits)
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.key[slot] == FREE)
            self.key[slot[put]], self.value[slot[put]] = keys[left[put]], values[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers; -1 for keys that aren't there."""
        slot = scattered(keys, self.bits)
        held = self.key[slot]
        out = np.where(held == keys, self.value[slot], -1)
        at = np.flatnonzero((held != keys) & (held != FREE))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            held = self.key[slot[at]]
            found = held == keys[at]
            out[at[found]] = self.value[slot[at[found]]]
            at = at[~found & (held != FREE)]
        return out


def scattered(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
