"""Text and page-label functions over columns; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import constants as K

#: White space as Unicode has it; Java's \s alone knows only ASCII.
SPACE = r"\s\x0b\x1c-\x1f\x85   -     　"
AROUND_LABEL = rf"[{SPACE}.·•()\[\]-]*"
LABEL = rf"\A{AROUND_LABEL}([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,10}}){AROUND_LABEL}\z"
ORDINAL = rf"\A[{SPACE}]*([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,10}})[.·):\-]+[{SPACE}]*\z"
#: Digits of a place in Roman numerals, zero first.
ROMAN = {
    1000: ["", "M", "MM", "MMM"],
    100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
}
CANONICAL = r"\A(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\z"


def normalize_text(text: Column) -> Column:
    """Case-folded words of a-z and 0-9, ``&`` as "and", single blanks between; other letters separate words."""
    folded = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), K.FOLDED.items(), text)
    return F.trim(F.regexp_replace(F.replace(F.lower(folded), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def int_to_roman(n: Column) -> Column:
    """Numeral of 1 to 3999, otherwise the empty string."""
    places = [F.element_at(F.array(*map(F.lit, digits)), (F.floor(n / place) % 10 + 1).cast("int")) for place, digits in ROMAN.items()]
    return F.when(n.between(1, 3999), F.concat(*places)).otherwise(F.lit(""))


def roman_to_int(numeral: Column) -> Column:
    """Value of a canonical numeral in either case; null for others."""
    upper = F.upper(numeral)
    places = [(F.array_position(F.array(*map(F.lit, digits)), F.regexp_extract(upper, CANONICAL, i + 1)) - 1) * place for i, (place, digits) in enumerate(ROMAN.items())]
    return F.when((numeral != "") & upper.rlike(CANONICAL), sum(places[1:], places[0]).cast("int"))


def parse_page_label(token: Column) -> Column:
    """struct(number, kind) of an Arabic or canonical Roman page label with punctuation around it; null for others."""
    core = F.regexp_extract(token, LABEL, 1)
    roman = roman_to_int(core)
    arabic = core.rlike(r"\A[0-9]")
    number = F.when(arabic, F.when(arabic, core).cast("int")).otherwise(roman)
    kind = F.when(arabic, F.lit("arabic")).otherwise(F.lit("roman"))
    return F.when((core != "") & number.isNotNull(), F.struct(number.alias("number"), kind.alias("kind")))


def ordinal_token(token: Column) -> Column:
    """Whether a word is a number or Roman letters followed by list punctuation."""
    return token.rlike(ORDINAL)


def roman_like(token: Column) -> Column:
    """One to six letters of which all, or all but one, are Roman digits: what a misread numeral looks like."""
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    digits = F.regexp_replace(letters, "[^IVXLCDMivxlcdm]", "")
    return F.length(letters).between(1, 6) & (F.length(digits) >= F.length(letters) - 1)


def clean_title(title: Column) -> Column:
    """A title without leader dots at its end and without separators at its edges."""
    bare = F.regexp_replace(title, rf"(?:[{SPACE}]*[.·•]{{2,}}[{SPACE}]*)+\z", "")
    return F.btrim(bare, F.lit(K.TITLE_EDGE))


def title_tokens(normalized: Column) -> Column:
    """Words of a normalised title that tell something: over two characters and no stop word."""
    return F.filter(F.split(normalized, " "), lambda t: (F.length(t) > 2) & ~t.isin(*K.STOPWORDS))


def title_match_score(title: Column, page: Column, tokens: Column | None = None, words: Column | None = None) -> Column:
    """How well a normalised title fits a normalised page: 1 if it is part of it, else the share of its words there.

    ``tokens`` of the title and ``words`` of the page may be given where each meets many of the others.
    """
    tokens = title_tokens(title) if tokens is None else tokens
    words = F.split(page, " ") if words is None else words
    share = F.size(F.array_intersect(tokens, words)) / F.size(F.array_distinct(tokens))
    return F.when(F.length(title) < K.TITLE_CHARS, F.lit(0.0)).when(F.contains(page, title), F.lit(1.0)).when(F.size(tokens) < K.TITLE_TOKENS, F.lit(0.0)).otherwise(share)


def is_heading(normalized: Column) -> Column:
    return normalized.isin(*K.TOC_HEADINGS)


def has_heading(normalized_page: Column) -> Column:
    """Whether a page holds the text of a contents heading, also inside a longer word."""
    return reduce(lambda a, b: a | b, [F.contains(normalized_page, F.lit(h)) for h in K.TOC_HEADINGS])


def repository_url(url: Column) -> Column:
    """``https://github.com/owner/name`` in lower case of the https, ssh and scp forms; null for others."""
    value = F.replace(F.trim(url), F.lit("\\"), F.lit("/"))
    scp = r"(?i)\Agit@github\.com:([^/]+)/([^/]+?)(?:\.git)?/?\z"
    web = r"\A(?i:https)://(?i:github\.com)/+([^/?#]+)/([^/?#]+?)(?:\.git)?/*\z"
    ssh = r"\A(?i:ssh)://git(?::[^@/?#]*)?@(?i:github\.com)(?::(?:22)?)?/+([^/?#]+)/([^/?#]+?)(?:\.git)?/*\z"
    out = F.lit(None).cast("string")
    for form in (ssh, web, scp):
        found = F.regexp_extract(value, form, 2)
        out = F.when((found != "") & (found != ".git"), F.lower(F.concat(F.lit("https://github.com/"), F.regexp_extract(value, form, 1), F.lit("/"), found))).otherwise(out)
    return out


def page_list(text: Column, page_count: Column) -> Column:
    """Sorted distinct 0-based pages of a list such as ``2,3`` (1-based); an error if empty, not a number or out of range."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    pages = F.transform(parts, lambda p: F.when(p.rlike(r"\A[0-9]{1,9}\z"), p).cast("int"))
    bad = (F.size(parts) == 0) | F.exists(pages, lambda p: F.coalesce((p < 1) | (p > page_count), F.lit(True)))
    return F.when(text.isNull(), F.lit(None)).when(bad, F.raise_error(F.concat(F.lit("invalid page list: "), text)).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.transform(pages, lambda p: p - 1))))


def requirement_pin(line: Column) -> Column:
    """struct(name, version) of a ``name==version`` line, the name in canonical form; null for others."""
    form = r"\A\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)"
    name = F.lower(F.regexp_replace(F.regexp_extract(line, form, 1), "[-_.]+", "-"))
    return F.when(name != "", F.struct(name.alias("name"), F.regexp_extract(line, form, 2).alias("version")))
