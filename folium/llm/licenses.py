"""Operator 9: license scan by template-markup matching.

A template is license wording with ``<<beginOptional>> ... <<endOptional>>``
around words that may be missing and ``<<var;max=N>>`` for up to N replaceable
words. It compiles to a token automaton over word hashes: each step is a word, a
jump past an optional part, or a bounded run of any words. A text is accepted by
a template where all mandatory wording stands, exactly and in order, from some
word on; not where the wording goes on as the template's ``<<unless>>`` part
("or any later version" after a notice of one version). Automata start only at
words where a template's two fixed opening words stand, which are found for all
words of a slice at once. Templates are in license_templates; those of whole licences
(license_texts) come first: a notice within an accepted whole text is part of it and
gives no label. Identifier lines (``SPDX-License-Identifier: A+ OR B``) are read as
they stand, each identifier of an expression by itself.

Beside the templates, fixed phrases give base labels. Words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.

Score: 1 where a template accepts or an identifier is known, 0.5 where only a base phrase occurs, else 0.

Defined cases: a null text counts as empty (no words, no labels, score 0);
repeated rows are scanned each; one pass, no shuffle, so an empty table gives no
rows; extra columns are left aside.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import small_batches
from folium.llm.license_templates import TEMPLATES, WHOLE, identifiers
from folium.llm.textvec import Words, mix, slices, utf8

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: An identifier line's key, and what an identifier is made of.
IDENTIFIER_LINE, IDENTIFIER = r"spdx-license-identifier:[ \t]*([^\r\n]*)", r"[a-z0-9.+-]+"


def parse(template: str) -> list:
    """Words, ("optional", [...]) and ("any", N) of a template, in order."""
    stack: list[list] = [[]]
    for mark, word in re.findall(r"<<([^>]*)>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)", template.lower()):
        if mark == "beginoptional":
            stack.append([])
        elif mark == "endoptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif mark:
            stack[-1].append(("any", int(mark.rpartition("max=")[2])))
        else:
            stack[-1].append(word)
    if len(stack) != 1:
        raise ValueError("unbalanced optional part")
    return stack[0]


@dataclass
class Automaton:
    """step[s]: (word hash, next state) for a word, (None, next) for any word; free[s]: states reachable without a word."""

    label: str
    opening: tuple[int, int]
    step: dict[int, tuple[int | None, int]]
    free: dict[int, list[int]]
    end: int

    def accepts(self, words: np.ndarray) -> int:
        """Words of the longest accepted start of `words`, 0 where there is none."""
        live, longest = self._closure({0}), 0
        for i, h in enumerate(words):
            live = self._closure({self.step[s][1] for s in live if s in self.step and self.step[s][0] in (None, int(h))})
            if not live:
                break
            if self.end in live:
                longest = i + 1
        return longest

    def _closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out


def fixed_words(parts: list) -> list[str]:
    return [w for p in parts for w in ([p] if isinstance(p, str) else fixed_words(p[1]) if p[0] == "optional" else [])]


def hashes(words: set[str]) -> dict[str, int]:
    """The hash of each word, all at once."""
    order = sorted(words)
    return dict(zip(order, Words(*utf8(pa.array(order, pa.string()))).hash.tolist(), strict=True))


def compile_template(label: str, parts: list, of: dict[str, int] | None = None) -> Automaton:
    """Thompson-style construction; the template must open with two fixed words. of: hashes of its words, where there are any."""
    of = hashes(set(fixed_words(parts))) if of is None else of
    step: dict[int, tuple[int | None, int]] = {}
    free: dict[int, list[int]] = {}
    count = 0

    def build(parts: list, at: int) -> int:
        nonlocal count
        for part in parts:
            if isinstance(part, str):
                count += 1
                step[at] = (of[part], count)
                at = count
            elif part[0] == "optional":
                inside = build(part[1], at_new := _new())
                free.setdefault(at, []).append(at_new)
                out = _new()
                free.setdefault(at, []).append(out)
                free.setdefault(inside, []).append(out)
                at = out
            else:
                out = _new()
                for _ in range(part[1]):
                    free.setdefault(at, []).append(out)
                    following = _new()
                    step[at] = (None, following)
                    at = following
                free.setdefault(at, []).append(out)
                at = out
        return at

    def _new() -> int:
        nonlocal count
        count += 1
        return count

    end = build(parts, 0)
    if not all(isinstance(part, str) for part in parts[:2]):
        raise ValueError("a template opens with two fixed words at least")
    return Automaton(label, (of[parts[0]], of[parts[1]]), step, free, end)


@dataclass
class Template:
    """What accepts, what must not follow (None: anything may), the most words that either looks at, whether it is a whole licence."""

    label: str
    wording: Automaton
    unless: Automaton | None
    most: int
    whole: bool

    def accepts(self, words: np.ndarray) -> int:
        used = self.wording.accepts(words[: self.most])
        return 0 if used and self.unless and self.unless.accepts(words[: self.most]) else used


def split(template: str) -> tuple[list, list | None]:
    """The wording's parts, and the wording's with what must not follow."""
    wording, _, rest = template.partition("<<unless>>")
    return parse(wording), parse(f"{wording} {rest}") if rest else None


def compiled(templates: dict[str, list[str]], whole: dict[str, str]) -> dict[int, list[Template]]:
    """Templates by the key of their opening words, those of whole licences first."""
    every = [(label, *split(text), True) for label, text in whole.items()] + [(label, *split(text), False) for label, texts in templates.items() for text in texts]
    of = hashes({w for _, wording, rest, _ in every for w in fixed_words(rest or wording)})
    out: dict[int, list[Template]] = {}
    for label, wording, rest, is_whole in every:
        t = Template(label, compile_template(label, wording, of), compile_template(label, rest, of) if rest else None, longest(rest or wording), is_whole)
        out.setdefault(int(pair_key(np.array(t.wording.opening, np.uint64))[0]), []).append(t)
    return out


@functools.cache
def every_template() -> dict[int, list[Template]]:
    return compiled(TEMPLATES, WHOLE)


def outside(spans: list[dict], whole: list[dict]) -> list[dict]:
    """Whole licences, and what doesn't lie within one."""
    return whole + [s for s in spans if not any(t["start"] <= s["start"] and s["end"] <= t["end"] for t in whole)]


def identified(text: bytes) -> list[tuple[int, int, list[str]]]:
    """(begin, end, labels) of each identifier line that has a known identifier."""
    found = []
    for line in re.finditer(IDENTIFIER_LINE.encode(), text.lower()):
        labels = [_IDENTIFIERS[x] for x in re.findall(IDENTIFIER, line[1].decode(errors="replace")) if x in _IDENTIFIERS]
        if labels:
            found.append((line.start(), line.end(), labels))
    return found


_IDENTIFIERS = identifiers()


def pair_key(words: np.ndarray) -> np.ndarray:
    """A key of each word with the next."""
    return mix(words[:-1] + np.uint64(0x9E3779B97F4A7C15) * words[1:])


def longest(parts: list) -> int:
    return sum(1 if isinstance(p, str) else p[1] if p[0] == "any" else longest(p[1]) for p in parts)


def parts_regex(parts: list) -> str:
    """The same language as a regular expression over words that each have one space before and after."""

    def of(parts: list) -> str:
        return "".join(f"{p} " if isinstance(p, str) else f"(?:[^ ]+ ){{0,{p[1]}}}" if p[0] == "any" else f"(?:{of(p[1])})?" for p in parts)

    return " " + of(parts)


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def runs_of(words: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions where a phrase's words stand consecutively in one document."""
    k = len(phrase)
    if len(words) < k:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[: len(words) - k + 1] == phrase[0])
    for j in range(1, k):
        at = at[words[at + j] == phrase[j]]
    return at[doc[at] == doc[at + k - 1]]


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row of documents.

    spans: label, first word, word after the last of each accepted place."""
    small_batches(documents.sparkSession)
    by_opening = compiled(templates, {}) if templates else every_template()
    openings = np.array(sorted(by_opening), np.uint64)
    of = hashes({x for phrase in PHRASES for x in phrase.split()})
    phrases = [(np.array([of[x] for x in phrase.split()], np.uint64), label) for phrase, label in PHRASES.items()]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches):
        for batch in batches:
            for part in slices(batch):
                buf, off = utf8(part.column("text"), lower=False)
                w = Words(_LOW[buf], off)
                n = w.n_docs
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set] = [set() for _ in range(n)]
                spans: list[list] = [[] for _ in range(n)]
                whole: list[list] = [[] for _ in range(n)]
                for phrase, label in phrases:
                    at = runs_of(w.hash, w.doc, phrase)
                    d = w.doc[at]
                    np.add.at(count, d, 1)
                    np.minimum.at(first, d, at - w.per_doc[d])
                    np.maximum.at(last, d, at - w.per_doc[d])
                    for i in np.unique(d):
                        base[i].add(label)
                key = pair_key(w.hash)
                for at in np.flatnonzero(np.isin(key, openings)):
                    d = w.doc[at]
                    begin = int(at - w.per_doc[d])
                    for t in by_opening[int(key[at])]:
                        used = t.accepts(w.hash[at : w.per_doc[d + 1]])
                        if used:
                            (whole if t.whole else spans)[d].append({"label": t.label, "start": begin, "end": begin + used})
                for d in range(n) if templates is None else ():
                    for a, b, found in identified(buf[off[d] : off[d + 1]].tobytes()):
                        a, b = (int(np.searchsorted(w.start, off[d] + x) - w.per_doc[d]) for x in (a, b))
                        spans[d] += [{"label": label, "start": a, "end": b} for label in found]
                spans = [outside(s, t) for s, t in zip(spans, whole, strict=True)]
                labels = [",".join(sorted(b | {s["label"] for s in p})) for b, p in zip(base, spans, strict=True)]
                none = count == 0
                columns = [
                    part.column("doc_id"), pa.array(w.counts()), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(np.where([bool(p) for p in spans], 1.0, np.where(none, 0.0, 0.5))), pa.array(spans, span),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>")


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows: words as a list, phrases by position, templates as regular expressions (of those with an
    <<unless>> part, more matches than go on with it), after each whole licence has been replaced by a mark."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    place = lambda p: f"list_transform(list_filter(range(0, len(w)), lambda i: {' and '.join(f'w[i + {k + 1}] = {quote(x)}' for k, x in enumerate(p.split()))}), lambda i: i)"
    base = ", ".join(f"case when len({place(p)}) > 0 then {quote(label)} end" for p, label in PHRASES.items())
    found = lambda parts: f"len(regexp_extract_all(s, {quote(parts_regex(parts))}))"
    opening = lambda parts: " ".join(next((parts[:k] for k, p in enumerate(parts) if not isinstance(p, str)), parts)[:8])

    def accepted(text: str) -> str:
        wording, rest = split(text)
        test = f"{found(wording)} > {found(rest) if rest else 0}"
        return f"contains(s, ' {wording[0]} {wording[1]} ') and {test}"

    steps, last = [], "t"
    for n, (label, text) in enumerate(WHOLE.items()):
        parts = parse(text)
        steps.append(f"m{n} as (select * replace (case when contains(s, ' {opening(parts)} ') then regexp_replace(s, {quote(parts_regex(parts))}, ' @{label} ', 'g') else s end as s) from {last})")
        last = f"m{n}"
    known = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in identifiers().items())
    extra = ", ".join(f"case when {' or '.join(f'({accepted(t)})' for t in texts)} then {quote(label)} end" for label, texts in TEMPLATES.items())
    extra += ", " + ", ".join(f"case when contains(s, ' @{label} ') then {quote(label)} end" for label in WHOLE)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda z: z is not null))), ','), '')"
    return rf"""
with r as (select doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as low from documents),
q as (select doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w,
  list_transform(regexp_extract_all(array_to_string(regexp_extract_all(low, {quote(IDENTIFIER_LINE)}, 1), ' '), {quote(IDENTIFIER)}), lambda x: (map {{{known}}})[x]) as named from r),
t as (select *, ' ' || array_to_string(w, ' ') || ' ' as s from q),
{", ".join(steps)},
p as (select doc_id, len(w) as n_words, {' || '.join(place(p) for p in PHRASES)} as places, [{base}] as base, [{extra}] || named as extra from {last})
select doc_id, n_words::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
  {joined('base')} as base_labels, {joined('base || extra')} as labels,
  case when len(list_filter(extra, lambda z: z is not null)) > 0 then 1.0 when len(places) > 0 then 0.5 else 0.0 end::double as score
from p"""
