"""Random printed books as positioned words, together with where their contents rows lead.

A book is drawn from a seed: volumes with a contents page each, runs of numbered
pages below it, sheets without a number in between. Which page a row means is
known from the drawing, so tests compare with that and not with stored answers.
"""

from __future__ import annotations

import random

WIDTH, HEIGHT = 560.0, 790.0
ROMAN = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
SYLLABLES = ["bar", "ton", "mel", "gri", "sov", "lun", "pek", "dra", "fil", "nor", "vas", "tum"]

#: Made up for these tests: three addresses, and eight words that only look like domains.
ADDRESSES = {"https://docs.example.net/start": "https://docs.example.net/start", "www.example.edu": "https://www.example.edu", "desk@example.net": "mailto:desk@example.net"}
LOOKALIKES = ["Sen.tence", "no.Space", "VOL.II", "p.ages", "Mc.Donald", "ed.Smith", "fig.four", "example.net"]


class Book:
    """Words of one document: ``line`` sets a string on the current page, ``page`` turns it."""

    def __init__(self, name: str):
        self.name, self.pages, self.words, self.targets = name, 0, [], {}

    def page(self) -> Book:
        self.pages, self.number = self.pages + 1, 0
        return self

    def line(self, text: str, left: float, top: float, size: float = 10.0) -> float:
        """Returns where the string ends."""
        for part in text.split():
            right = left + size * len(part) / 2
            self.words.append((self.name, self.pages - 1, self.number, part, float(left), float(right), float(top), float(top + size)))
            self.number += 1
            left = right + size / 4
        return left - size / 4


def _title(rnd: random.Random, seen: set[str]) -> str:
    while True:
        title = " ".join("".join(rnd.sample(SYLLABLES, 3)).capitalize() for _ in range(3))
        if title not in seen:
            seen.add(title)
            return title


def drawn(name: str, seed: int, volumes: list[list[tuple[str, int, int, int]]], lost: int = 0, damaged: int = 0) -> Book:
    """A book of ``volumes``, each a list of runs (kind, first number, pages, unnumbered sheets before).

    ``lost``: so many numbers of each gap between runs are listed although no page bears them.
    ``damaged``: so many more rows whose numeral is no numeral.
    ``targets``: (title, label) -> page from 1, for the rows that lead somewhere.
    """
    rnd, seen, book = random.Random(seed), set(), Book(name)
    for runs in volumes:
        shown = lambda kind, n: ROMAN[n] if kind == "roman" else str(n)
        sheets: list[tuple[str, str | None]] = []
        rows: list[tuple[str, str]] = []
        end = 0
        for kind, first, count, bare in runs:
            rows += [(_title(rnd, seen), shown(kind, n)) for n in range(end + 1, first)][:lost] if end else []
            sheets += [(_title(rnd, seen), None) for _ in range(bare)]
            numbered = [(_title(rnd, seen), shown(kind, n)) for n in range(first, first + count)]
            sheets, rows, end = sheets + numbered, rows + numbered, first + count - 1 if kind == "arabic" else 0
        rows += [(_title(rnd, seen), "".join(rnd.sample("xvi", 3)).replace("xvi", "vxi").replace("xiv", "vxi")) for _ in range(damaged)]
        book.page().line("Contents", 60, 50, 18)
        for i, (title, label) in enumerate(rows):
            book.line(title, 60, 100 + 22 * i)
            book.line(label, WIDTH - 80, 100 + 22 * i)
        start = book.pages
        for i, (title, label) in enumerate(sheets, 1):
            book.page().line(title, 60, 90, 16)
            book.line("and some words of its own below", 60, 130)
            if label:
                book.line(label, WIDTH / 2 - 3, HEIGHT - 40)
                book.targets[title, label] = start + i
    return book


def sizes(seed: int, n: int) -> list[int]:
    """Lengths of runs, four to six pages each."""
    rnd = random.Random(seed)
    return [rnd.randint(4, 6) for _ in range(n)]


def two_numberings(name: str = "mixed", seed: int = 21) -> Book:
    """Roman pages after an unnumbered sheet, then Arabic ones, listed together."""
    a, b = sizes(seed, 2)
    return drawn(name, seed, [[("roman", 1, a, 1), ("arabic", 1, b, 0)]])


def restarting(name: str = "volumes", seed: int = 22, volumes: int = 4) -> Book:
    """Volumes whose numbers all start at one again."""
    return drawn(name, seed, [[("arabic", 1, n, 0)] for n in sizes(seed, volumes)])


def skipping(name: str = "skips", seed: int = 23, lost: int = 0) -> Book:
    """A number is left out in print; with ``lost`` it is listed all the same."""
    a, b = sizes(seed, 2)
    return drawn(name, seed, [[("arabic", 1, a, 1), ("arabic", a + 2, b, 0)]], lost=lost)


def blotted(name: str = "blotted", seed: int = 24) -> Book:
    """One row's numeral can't be read."""
    return drawn(name, seed, [[("arabic", 1, sizes(seed, 1)[0], 0)]], damaged=1)


def addresses(name: str = "addresses") -> Book:
    book = Book(name).page()
    for i, token in enumerate([*ADDRESSES, *LOOKALIKES]):
        book.line(token, 60, 80 + 28 * i)
    return book
