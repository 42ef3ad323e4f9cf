"""Language identification by words first, then by ever shorter character n-grams.

The model holds per-language log frequencies of words, and of n-grams of marked
words (``^word$``) of five to one characters. A known word adds its own log
frequencies; an unseen word adds the mean of its longest known n-grams.

Fitting uses at most about ``docs_per_lang`` labelled documents of a language
(a documented bound, drawn by a hash of the id) and keeps every word and n-gram
that occurs ``least_count`` times or more in them, so the model that is sent to
the executors doesn't grow with the corpus. Every document is scored whole,
without any exchange.

The score is the posterior of the best language with the evidence of at most
``EVIDENCE`` average words, so that a text in two languages doesn't reach 1.

A letter is a character of Unicode's categories L; marks belong to the letter
before them. Defined cases: null text and text without a letter give ``und`` and
0; with nothing to learn from, all texts do. Of languages of equal score the
first by name is taken. Rows are scored each, also repeated ones; an empty table
gives an empty one. Other columns are ignored, or carried along where asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import Table, cut, slices, spans

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST, EVIDENCE, SMOOTH = 5, 20, 0.5
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    """True for the third of the ids that is never learned from; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, langs: list[str], entries: Iterable[tuple[str, int, str, int]]):
        """entries: (lang, n-gram length or 0 for a word, text, count)."""
        self.langs = langs
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        index = {x: i for i, x in enumerate(langs)}
        places: dict[int, dict[str, int]] = {}
        cells: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for lang, n, text, count in entries:
            place = places.setdefault(n, {})
            row, col, value = cells.setdefault(n, ([], [], []))
            row.append(place.setdefault(text, len(place)))
            col.append(index[lang])
            value.append(count)
        parts, size = [], 0
        for n, place in sorted(places.items()):
            counts = np.zeros((len(place), len(langs)))
            np.add.at(counts, (cells[n][0], cells[n][1]), cells[n][2])
            parts.append((np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * (len(place) + 1))).astype(np.float32))
            (self.grams if n else self.words).update((text, size + i) for text, i in place.items())
            size += len(place)
        self.logs = np.concatenate(parts) if parts else np.zeros((0, len(langs)), np.float32)
        self.packed: tuple | None = ()  # made where it is used

    def _packed(self) -> tuple[dict[int, int], int, list[Table]] | None:
        """(numbers of the n-grams' characters, bits of a number, n-grams of each length); None if five numbers don't fit into 62 bits."""
        letters = {ord(c): i for i, c in enumerate(sorted({c for g in self.grams for c in g}), 1)}
        bits = max(1, len(letters).bit_length())
        if bits * LONGEST > 62:
            return None
        keys: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        rows: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        for g, row in self.grams.items():
            key = 0
            for c in g:
                key = key << bits | letters[ord(c)]
            keys[len(g)].append(key)
            rows[len(g)].append(row)
        return letters, bits, [Table(np.array(k, np.uint64), np.array(r, np.int32)) for k, r in zip(keys, rows, strict=True)]

    def _guess(self, words: list[str]) -> np.ndarray:
        """The scores of words that the model doesn't hold: the mean of their longest known n-grams."""
        if self.packed == ():
            self.packed = self._packed()
        if self.packed is None or not words:
            return self._guess_each(words)
        letters, bits, tables = self.packed
        out = np.zeros((len(words), len(self.langs)), np.float32)
        code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, where = np.unique(code, return_inverse=True)
        number = np.array([letters.get(c, 0) for c in kinds.tolist()], np.uint64)[where]  # 0 is in no n-gram
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(size)
        left = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            count = np.maximum(0, size[left] - n + 1)
            place = spans((end - size)[left], count)
            key = number[place]
            for k in range(1, n):
                key = key << np.uint64(bits) | number[place + k]
            row = tables[n].get(key)
            of = np.repeat(np.arange(len(left)), count)[row >= 0]
            row = row[row >= 0]
            if len(of):
                some, starts, many = np.unique(of, return_index=True, return_counts=True)
                out[left[some]] = np.add.reduceat(self.logs[row], starts, axis=0) / many[:, None]
                left = np.delete(left, some)
        return out

    def _guess_each(self, words: list[str]) -> np.ndarray:
        """``_guess`` word by word, for alphabets of any size."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        ids, sizes, rows = [], [], []
        grams = self.grams
        for row, word in enumerate(words):
            marked = f"^{word}$"
            for n in range(LONGEST, 0, -1):
                found = [g for i in range(len(marked) - n + 1) if (g := grams.get(marked[i : i + n])) is not None]
                if found:
                    ids += found
                    sizes.append(len(found))
                    rows.append(row)
                    break
        if rows:
            size = np.array(sizes)
            out[rows] = np.add.reduceat(self.logs[ids], np.cumsum(size) - size, axis=0) / size[:, None]
        return out

    def _word_scores(self, words: list[str]) -> np.ndarray:
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out = np.empty((len(words), len(self.langs)), np.float32)
        out[known >= 0] = self.logs[known[known >= 0]]
        unseen = np.flatnonzero(known < 0)
        out[unseen] = self._guess([words[i] for i in unseen.tolist()])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                words += WORDS.findall(t.lower())
            ends.append(len(words))
        size = np.diff(ends)
        score, langs = np.zeros(len(texts)), [UNKNOWN] * len(texts)
        if not words or not self.langs:
            return langs, score
        held = pa.array(words, pa.string()).dictionary_encode()
        del words
        each = self._word_scores(held.dictionary.to_pylist()).astype(np.float64)
        some = np.flatnonzero(size)
        total = np.add.reduceat(each[held.indices.to_numpy()], np.array(ends)[some], axis=0)
        total *= np.minimum(1, EVIDENCE / size[some])[:, None]
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        score[some] = p.max(1)
        for row, best in zip(some.tolist(), p.argmax(1).tolist(), strict=True):
            langs[row] = self.langs[best]
        return langs, score


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, text, count): how often each word occurs in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        for lang, count in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count)), pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["lang", "text", "count"])

    return rows.mapInArrow(run, "lang string, text string, count long").groupBy("lang", "text").agg(F.sum("count").alias("count"))


def _gram_counts(words: DataFrame) -> DataFrame:
    """(lang, n, text, count): how often each n-gram of the marked words occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[tuple[str, int], Counter[str]] = {}
        for batch in batches:
            for lang, w, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "count")), strict=True):
                marked = f"^{w}$"
                for n in range(1, LONGEST + 1):
                    count = grams.setdefault((lang, n), Counter())
                    for i in range(len(marked) - n + 1):
                        count[marked[i : i + n]] += k
        for (lang, n), count in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count)), pa.array([n] * len(count), pa.int32()), pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["lang", "n", "text", "count"])

    return words.mapInArrow(run, "lang string, n int, text string, count long").groupBy("lang", "n", "text").agg(F.sum("count").alias("count"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 500, least_count: int = 2) -> Model:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out("id") & F.col("lang").isNotNull())
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not size:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, int(min(1.0, docs_per_lang / n) * (1 << 30)))])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) < share[F.col("lang")]).where("text is not null")
    words = cut(_word_counts(drawn))
    counts = words.select("lang", F.lit(0).alias("n"), "text", "count").union(_gram_counts(words)).where(F.col("count") >= least_count)
    found = counts.toArrow()  # columns, not rows: the driver holds the model only once
    columns = [found.column(c).to_pylist() for c in ("lang", "n", "text", "count")]
    order = sorted(range(found.num_rows), key=lambda i: (columns[0][i], columns[1][i], columns[2][i]))
    return Model(sorted(size), ((columns[0][i], columns[1][i], columns[2][i], columns[3][i]) for i in order))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Only the text decides.

    With ``carry`` all columns of ``docs`` come along; those named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    rows = docs.select(*own, held_out(id_col).alias("held_out")) if carry else docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("held_out"))
    kept = [*own, "held_out"] if carry else [id_col, "held_out"]
    schema = T.StructType([rows.schema[c] for c in kept]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                langs, score = shared.value.predict(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(langs), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
