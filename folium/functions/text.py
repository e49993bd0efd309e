"""Text expressions. Characters are code points, bytes UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that count as one when spelling variants are searched.
VARIANTS = ("eéè", "oó", "aáà", "ií", "uúü", "sß")
PUNCTUATION = r"[\p{P}\p{S}\p{Z}\s]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """The characters of a text as an array; positions in a string cost its length, in an array nothing."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def character(code: Column) -> Column:
    """The character of a code point; F.chr only knows the first 256. A byte order mark goes before, as decoding takes one away."""
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")


def over_ngrams(text: Column, n: int, make) -> Column:
    """make(characters, i) for the start i (from 1) of every run of n characters; the array is built once a text."""
    runs = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: make(c, i)))
    return F.get(F.transform(F.array(characters(text)), runs), F.lit(0))


def ngrams(text: Column, n: int) -> Column:
    """Every run of n characters, in order; none where the text is shorter."""
    return F.coalesce(over_ngrams(text, n, lambda c, i: F.array_join(F.slice(c, i, n), "")), F.array().cast("array<string>"))


def occurrences(text: Column, term: str | Column) -> Column:
    """Non-overlapping occurrences of a term."""
    term = F.lit(term) if isinstance(term, str) else term
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def fold(text: Column) -> Column:
    """Each letter of a variant class replaced by the class's first."""
    src = "".join(c for group in VARIANTS for c in group[1:])
    dst = "".join(group[0] for group in VARIANTS for _ in group[1:])
    return F.translate(text, src, dst)


def variants(query: str, most: int = 64) -> list[str]:
    """Spellings of a query with each letter replaced by its class's others; stops branching above `most` forms."""
    forms = [""]
    for c in query:
        group = next((g for g in VARIANTS if c in g), c)
        options = [c, *[x for x in group if x != c]]
        if len(forms) * len(options) > most:
            options = [c]
        forms = [f + x for f in forms for x in options]
    return forms


def query_ngrams(query: str, n: int = 3) -> list[str]:
    """Windows of n characters of a query, without those of punctuation or space alone; a short query is its own window."""
    query = query.strip()
    if len(query) <= n:
        return [query] if query else []
    grams = (query[i : i + n] for i in range(len(query) - n + 1))
    return list(dict.fromkeys(g for g in grams if "\n" not in g and any(c.isalnum() for c in g)))


def query_words(query: str, least: int = 3, most: int = 20) -> list[str]:
    """A query's words of `least` letters or more, longest first."""
    found = dict.fromkeys(w for w in "".join(c if c.isalnum() else " " for c in query).split() if len(w) >= least)
    return sorted(found, key=lambda w: (-len(w), w))[:most]
