"""SentencePiece encoding and decoding along a trie of distinct marked words.

Texts are marked as the model's normaliser does (a leading mark, blanks turned
into marks) and cut before every run of marks, where no piece can reach across.
The distinct marked words of a slice of rows are sorted, which is the depth-first
order of their trie. The order is walked in runs of ``RUN`` words, each a stretch
of the depth-first order; within a run all branches advance together by one place
in numpy. A node of the trie is computed once, for the first word that has it;
every word below reads the forward states of its prefix from there.

The forward state of a node is that of its prefix's segmentation:

* unigram models: the best sum of piece scores and the last piece (Viterbi);
* BPE models: the last piece that the merges leave. It is the only piece t that
  ends there, keeps together by itself, and stays apart from the last piece
  before it; sums of BPE scores would not give the merges' segmentation.

The pieces that end at a node are found by walking a trie of reversed pieces
backwards from it. Words of over ``LONG`` characters, of which there are few at a
time, take the same steps one place after another (``segment``).

Characters outside the vocabulary become byte pieces, or the unknown piece if
the model has none. Decoding joins pieces and bytes and takes the marks back.
Null text is empty text: no pieces. Repeated rows are encoded each; an empty table
gives an empty one; columns other than id and text are left out, whatever their
names. A text that holds the mark itself (U+2581) decodes with blanks, so its
round trip is reported as not exact; any other is exact under byte fallback.
Models with pieces that the user defined are refused: those come before the merges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import FREE, Table, scattered, slices, spans

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words whose pieces a worker remembers; beyond it the older half goes. Bits of its memory of pairs.
REMEMBERED, PAIRS = 150_000, 19
#: Words of a run of the depth-first order; characters from which on a word is walked by itself.
RUN, LONG = 1 << 14, 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value: int | bytes = number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Pieces:
    """The vocabulary of a model file: plain lists and dicts, of the size of that file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool, dummy_prefix: bool):
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.type = [t for _, _, t in pieces]
        if USER in self.type:
            raise ValueError("models with pieces defined by the user can't be used")
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.unknown = next((i for i, t in enumerate(self.type) if t == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE} if byte_fallback else {}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id), default=1)
        self.floor = min(self.score, default=0.0) - 10  # of a character outside the vocabulary
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.id)
        inside = {c for p in self.id if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\x0b\x0c\r" if c not in inside)
        self._bytes: pa.Array | None = None
        self.bytes = [b"" if t in (CONTROL, UNKNOWN) else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, (p, _, t) in enumerate(pieces)]

    @classmethod
    def read(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, byte_fallback, dummy = [], UNIGRAM, False, True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                kind, byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(1, b"") not in (b"", b"identity") or spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that leave characters and blanks as they are can be used")
        return cls(pieces, kind, byte_fallback, dummy)

    def byte_array(self) -> pa.Array:
        if self._bytes is None:
            self._bytes = pa.array(self.bytes, pa.binary())
        return self._bytes

    def merged(self, text: str) -> list[str]:
        """What the merges leave of a short text, step by step: the definition that the trie's states follow."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes slices of texts; remembers words and pairs between them. Its tables are made on the driver and sent along."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.apart: dict[tuple[str, str], bool] = {}
        self.ties = {s for s, n in _tally(pieces.score[i] for i in pieces.id.values()).items() if n > 1}
        self._remember()
        by_last: dict[str, set[int]] = {}
        for t in pieces.id:
            by_last.setdefault(t[-1], set()).add(len(t))
        self.lengths = {c: sorted(n - {1}, reverse=True) for c, n in by_last.items()}
        self._symbols()

    def _remember(self) -> None:
        """Start with empty memories."""
        self.halves = lru_cache(maxsize=None)(self._halves)  # one entry a piece at most, as below
        self.in_order = lru_cache(maxsize=None)(self._in_order)
        self.known: dict[bytes, int] = {}  # word -> its number in:
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pair = np.full(1 << PAIRS, FREE, np.uint64)
        self.pair_stays = np.zeros(1 << PAIRS, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("halves", "in_order", "known", "sizes", "ids", "pair", "pair_stays", "apart")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, apart={})
        self._remember()

    def _symbols(self) -> None:
        """Pieces, and the characters inside them, as numbers with their scores, halves and order, for the walk in numpy."""
        p = self.p
        bpe = p.kind == BPE
        symbols = list(p.id)
        symbols += sorted({c for t in p.id for c in t} - set(p.id))
        number = {t: i for i, t in enumerate(symbols)}
        n = len(symbols)
        self.text_of = symbols
        self.size = np.array([*map(len, symbols), 1], np.int32)  # the last stands for characters outside all pieces, -1
        self.piece = np.array([*(p.id.get(t, -1) for t in symbols), -1], np.int32)
        score = np.array([*(p.score[p.id[t]] if t in p.id else -np.inf for t in symbols), -np.inf])
        self.score = score
        states: dict[tuple[int, str], int] = {}
        ends = [-1]
        for t, i in number.items():
            if len(t) > 1 and bpe and self.halves(t) == ("", ""):
                continue  # its own merges don't give it
            at = 0
            for c in reversed(t):
                at = states.setdefault((at, c), len(states) + 1)
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        self.backwards = Table(np.array([s << 21 | ord(c) for s, c in states], np.uint64), np.array(list(states.values()), np.int32))
        if not bpe:
            return
        merged = [t for t in p.id if len(t) > 1]
        splits = [(number[t[:k]], number[t[k:]], number[t]) for t in merged for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
        self.across = Table(np.array([x * n + y for x, y, _ in splits], np.uint64), np.array([z for _, _, z in splits], np.int32))
        self.rank = np.where(self.size > 1, score, np.inf)  # of a symbol's last merge
        self.tied = np.isin(score, list(self.ties)) & (self.size > 1)
        self.tied_piece = np.isin(score, list(self.ties))
        self.left, self.right, self.sound = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.ones(n + 1, bool)
        for t in merged:
            halves, i = self.halves(t), number[t]
            if halves != ("", ""):
                self.left[i], self.right[i], self.sound[i] = number[halves[0]], number[halves[1]], self.in_order(t)

    def _halves(self, text: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None for a character; ("", "") for a piece that its own merges don't give."""
        if len(text) == 1:
            return None
        parts = list(text)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.p.id.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.p.score[k] > best):
                    best, at = self.p.score[k], i
            if at < 0:
                return "", ""
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else ("", "")

    def _in_order(self, text: str) -> bool:
        """Whether the parts of a piece, down to characters, are all merged before what they make up."""
        parts = self.halves(text)
        if parts is None:
            return True
        own = self.p.score[self.p.id[text]]
        return all(len(x) == 1 or (self.p.score[self.p.id[x]] >= own and self.in_order(x)) for x in parts)

    def _stay(self, a: str, b: str) -> bool:
        """Whether the merges of a + b leave a and b: undo the last merges on both sides, looking for one across.

        Of equal scores the leftmost merges first, so a merge across comes before an equal one in b and after one in a.
        """
        ids, score = self.p.id, self.p.score
        if not (self.in_order(a) and self.in_order(b)):
            return self.p.merged(a + b) == [a, b]
        left, right = a, b
        last, right_undone = -float("inf"), False
        while True:
            across = ids.get(left + right)
            if across is not None:
                if score[across] in self.ties:  # several pieces share the score
                    return self.p.merged(a + b) == [a, b]
                if score[across] > last or (right_undone and score[across] == last):
                    return False
            rank_left = score[ids[left]] if len(left) > 1 else float("inf")
            rank_right = score[ids[right]] if len(right) > 1 else float("inf")
            if rank_left in self.ties or rank_right in self.ties:
                return self.p.merged(a + b) == [a, b]
            if rank_left == rank_right == float("inf"):
                return True
            right_undone = rank_right <= rank_left
            if right_undone:
                last, right = rank_right, self.halves(right)[0]
            else:
                last, left = rank_left, self.halves(left)[1]

    def stay(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            found = self.apart[a, b] = self._stay(a, b)
        return found

    def segment(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The pieces of distinct words in the order of their trie, one place after another: what ``walk`` does for short words."""
        bpe = self.p.kind == BPE
        before = ""
        last: list[str] = [""]  # by place: the last piece of the prefix that ends there
        score = [0.0]
        out = {}
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                (self._next_merge if bpe else self._next_best)(word, end, last, score)
            before = word
            at, found = len(word), []
            while at:
                found.append(last[at])
                at -= len(last[at])
            out[word] = self._ids(found[::-1])
        return out

    def _next_merge(self, word: str, end: int, last: list[str], score: list[float]) -> None:
        ids = self.p.id
        for n in self.lengths.get(word[end - 1], ()):
            if n <= end:
                t = word[end - n : end]
                if t in ids and self.halves(t) != ("", "") and (n == end or self.stay(last[end - n], t)):
                    last.append(t)
                    score.append(0.0)
                    return
        last.append(word[end - 1])
        score.append(0.0)

    def _next_best(self, word: str, end: int, last: list[str], score: list[float]) -> None:
        p = self.p
        best, piece = score[end - 1] + p.floor, word[end - 1]
        for n in range(min(p.longest, end), 0, -1):
            t = word[end - n : end]
            k = p.id.get(t)
            if k is not None and score[end - n] + p.score[k] > best:
                best, piece = score[end - n] + p.score[k], t
        last.append(piece)
        score.append(best)

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stay`` of many pairs of symbols at once."""
        out = np.ones(len(a), bool)
        plain = self.sound[a] & self.sound[b]
        slow = [np.flatnonzero(~plain)]
        at = np.flatnonzero(plain)
        left, right = a[at], b[at]
        last, undone = np.full(len(at), -np.inf), np.zeros(len(at), bool)
        n = np.uint64(len(self.text_of))
        while len(at):
            across = self.across.get(left.astype(np.uint64) * n + right.astype(np.uint64))
            there, rank = across >= 0, self.score[across]
            ranks = self.rank[left], self.rank[right]
            tie = there & self.tied_piece[across]
            no = there & ~tie & ((rank > last) | (undone & (rank == last)))
            tie |= ~no & (self.tied[left] | self.tied[right])
            out[at[no]] = False
            slow.append(at[tie])
            go = ~(no | tie | ((ranks[0] == np.inf) & (ranks[1] == np.inf)))
            undone = (ranks[1] <= ranks[0])[go]
            last = np.where(undone, ranks[1][go], ranks[0][go])
            at, left, right = at[go], left[go], right[go]
            left, right = np.where(undone, left, self.right[left]), np.where(undone, self.left[right], right)
        for i in np.concatenate(slow).tolist():
            out[i] = self._stay(self.text_of[a[i]], self.text_of[b[i]])
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stays`` with a memory; -1 on the left is a character that no piece holds, or the start of the word."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero(a >= 0)
        key = a[at].astype(np.uint64) << np.uint64(32) | b[at].astype(np.uint64)
        slot = scattered(key, PAIRS)
        out[at] = self.pair_stays[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            fresh, where = np.unique(key[new], return_inverse=True)
            found = self._stays((fresh >> np.uint64(32)).astype(np.int64), (fresh & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[at[new]] = found[where]
            slot = scattered(fresh, PAIRS)
            self.pair[slot], self.pair_stays[slot] = fresh, found
        return out

    def walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """For sorted distinct words: (symbols of all, their number in each, words that hold characters outside the vocabulary)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        width, n = int(size.max()), len(words)
        code = np.zeros((width, n), np.uint32)
        place, owner = spans(np.zeros(n, np.int64), size), np.repeat(np.arange(n), size)
        code[place, owner] = flat
        same = np.zeros(n, np.int64)  # characters shared with the word before
        same[1:] = np.minimum.accumulate(code[:, 1:] == code[:, :-1], axis=0).sum(0)
        same[1:] = np.minimum(same[1:], np.minimum(size[1:], size[:-1]))
        last = np.full((width + 1, n), -1, np.int32)
        best = np.zeros((width + 1, n)) if self.p.kind != BPE else None
        for end in range(1, width + 1):
            there = np.flatnonzero(size >= end)
            new = same[there] < end
            node = there[new]
            symbol, score = self._advance(code, last, best, node, end)
            group = np.cumsum(new) - 1
            last[end, there] = symbol[group]
            if best is not None:
                best[end, there] = score[group]
        at, row = size.copy(), np.arange(n)
        found, rows = [], []
        while len(row):
            symbol = last[at[row], row]
            found.append(symbol)
            rows.append(row)
            at[row] -= self.size[symbol]
            row = row[at[row] > 0]
        rows_of, symbols = np.concatenate(rows), np.concatenate(found)
        count = np.bincount(rows_of, minlength=n)
        turn = np.repeat(np.arange(len(rows)), [len(r) for r in rows])  # 0 for a word's last piece
        out = np.empty(len(symbols), np.int32)
        out[(np.cumsum(count))[rows_of] - 1 - turn] = symbols
        odd = np.unique(rows_of[self.piece[symbols] < 0]).tolist()
        return out, count, odd

    def _advance(self, code: np.ndarray, last: np.ndarray, best: np.ndarray | None, node: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The last symbols of the prefixes of length ``end`` of some words, and the sums of their scores."""
        alive, state = np.arange(len(node)), np.zeros(len(node), np.uint64)
        symbol = np.full(len(node), -1, np.int32)
        score = None if best is None else best[end - 1, node] + self.p.floor
        whose, which, starts = [], [], []
        for k in range(1, min(end, self.p.longest) + 1):
            state = self.backwards.get(state << np.uint64(21) | code[end - k, node[alive]].astype(np.uint64))
            alive, state = alive[state >= 0], state[state >= 0]
            if not len(alive):
                break
            piece = self.ends[state]
            state = state.astype(np.uint64)
            hit = piece >= 0
            who, piece = alive[hit], piece[hit]
            if best is not None:  # of equal sums the longer piece
                real = self.piece[piece] >= 0
                who, piece = who[real], piece[real]
                total = best[end - k, node[who]] + self.score[piece]
                better = total >= score[who] if k > 1 else total > score[who]
                symbol[who[better]], score[who[better]] = piece[better], total[better]
            elif k == 1:
                symbol[who] = piece
            else:
                whose.append(who)
                which.append(piece)
                starts.append(last[end - k, node[who]] if end > k else np.full(len(who), -1, np.int32))
        if whose:
            who, piece = np.concatenate(whose), np.concatenate(which)
            stays = self._pairs(np.concatenate(starts).astype(np.int64), piece.astype(np.int64))
            symbol[who[stays]] = piece[stays]  # the longest comes last, and stands
        return symbol, score

    def pieces_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, their number in each) for sorted distinct words."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        apart: dict[int, tuple[int, ...]] = {}
        if len(short) < len(words):
            long = [i for i, w in enumerate(words) if len(w) > LONG]
            found = self.segment([words[i] for i in long])
            apart = {i: found[words[i]] for i in long}
        flats, counts = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        for at in range(0, len(short), RUN):
            run = short[at : at + RUN]
            symbols, count, odd = self.walk([words[i] for i in run])
            ids = self.piece[symbols]
            if odd:
                ends = np.cumsum(count)
                keep = np.ones(len(run), bool)
                for k in odd:
                    apart[run[k]] = self._spelled(words[run[k]], symbols[ends[k] - count[k] : ends[k]].tolist())
                    keep[k] = False
                ids = ids[np.repeat(keep, count)]
                count[odd] = 0
            counts[run] = count
            flats.append(ids)
        ids = np.concatenate(flats)
        if not apart:
            return ids, counts
        all_counts = counts.copy()
        rows = sorted(apart)
        all_counts[rows] = [len(apart[i]) for i in rows]
        out = np.empty(int(all_counts.sum()), np.int32)
        starts = np.cumsum(all_counts) - all_counts
        out[spans(starts, counts)] = ids
        out[spans(starts[rows], all_counts[rows])] = [k for i in rows for k in apart[i]]
        return out, all_counts

    def _spelled(self, word: str, symbols: list[int]) -> tuple[int, ...]:
        """The ids of a word's symbols, characters outside the vocabulary as bytes or as the unknown piece."""
        at, parts = 0, []
        for s in symbols:
            n = int(self.size[s])
            parts.append(word[at : at + n])
            at += n
        return self._ids(parts)

    def _ids(self, parts: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        for t in parts:
            k = self.p.id.get(t)
            if k is not None:
                ids.append(k)
            elif self.p.byte:
                ids += [self.p.byte[b] for b in t.encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.p.unknown:
                ids.append(self.p.unknown)
        return tuple(ids)

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(bytes of all words, blanks for marks; number of words of each text; bytes of each text with its prefix)."""
        blank = " " if self.p.dummy_prefix else ""
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(blank, pc.replace_substring(texts, MARK, " "), ""))
        bounds = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        new = np.zeros(len(data) + 1, bool)
        new[bounds] = True
        if not self.p.crosses and len(data):
            mark = data == 32
            new[:-1] |= mark & np.r_[True, ~mark[:-1]]
            if self.p.alone:
                alone = np.isin(data, np.frombuffer(self.p.alone.encode(), np.uint8))
                new[:-1] |= alone
                new[1:] |= alone
        new[-1] = True
        starts = np.flatnonzero(new)
        words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.diff(np.searchsorted(starts, bounds)), np.diff(bounds)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words, in the arrays of what is known."""
        if len(self.known) > REMEMBERED:
            self.known = {w: i for i, w in enumerate(list(self.known)[len(self.known) // 2 :])}
            gone = len(self.sizes) - len(self.known)
            self.ids, self.sizes = self.ids[self.sizes[:gone].sum() :], self.sizes[gone:]
        new = sorted(w for w in words if w not in self.known)
        if new:
            # a blank sorts before all characters of words, the mark does not: words are sorted by what they hold
            found = sorted((w.decode().replace(" ", MARK), w) for w in new)
            ids, sizes = self.pieces_of([w for w, _ in found])
            self.known.update({w: i for i, (_, w) in enumerate(found, len(self.sizes))})
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.string())
        words, counts, _ = self._words(pc.fill_null(texts, ""))
        held = words.dictionary_encode()
        number = self._learn(held.dictionary.to_pylist())[held.indices.to_numpy()]
        size = self.sizes[number]
        ids = self.ids[spans((np.cumsum(self.sizes) - self.sizes)[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


def _tally(values: Iterator[float]) -> dict[float, int]:
    out: dict[float, int] = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of a sequence of ids."""
    text = b"".join(map(pieces.bytes.__getitem__, ids.tolist()))
    text = text.decode("utf-8", "replace")
    return text[1:] if pieces.dummy_prefix and text.startswith(" ") else text


def decode_all(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of many sequences, each from one of ``ends`` to the next."""
    held = pieces.byte_array().take(pa.array(ids))
    at = np.frombuffer(held.buffers()[1], np.int32)[: len(ids) + 1][ends]
    data = (held.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    prefix = pieces.dummy_prefix
    texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist(), strict=False))
    return pa.array([t[1:] if prefix and t.startswith(" ") else t for t in texts], pa.string())


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int), n_pieces, round_trip (decoding the ids gives the text), without begin or end pieces.

    ``model``: path on the driver of a SentencePiece model whose normaliser is the identity.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(Pieces.read(model)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        pieces = encoder.p
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                ids, sizes = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                same = pc.equal(decode_all(pieces, ids, ends), texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(sizes), same], names=["id", "ids", "n_pieces", "round_trip"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_pieces long, round_trip boolean")
    return made.withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text. Null ids decode to empty text; an id outside the vocabulary is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces.read(model))
    rows = rows.select(F.col(id_col), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(shared.value, np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")
