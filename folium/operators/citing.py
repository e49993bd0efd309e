"""Foreign forms of citation, addresses that count lines, rewriting, repair of quotes; anchors of parallels; genres; readings."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.operators.evidence import QUOTES
from folium.session import share_package

OCCURRENCE = "form string, start long, end long, work string, volume long, page long, register string, line long, from_foot boolean, segment string"
#: The letter of the collection, registers of a page, and the digits of the database form's work, volume, page, line.
COLLECTION, REGISTERS, DATABASE_DIGITS = "T", "abc", (4, 2, 4, 2)


class _Reader:
    """A place in a text that moves over what it is asked for; anything else raises ValueError."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def run(self, kinds, least: int, most: int) -> str:
        begin = self.at
        while self.at < len(self.text) and self.at - begin < most and kinds(self.text[self.at]):
            self.at += 1
        if self.at - begin < least:
            raise ValueError(f"at {begin}")
        return self.text[begin : self.at]

    def number(self, least: int, most: int) -> int:
        return int(self.run(_digit, least, most))

    def one_of(self, letters: str) -> str:
        return self.run(lambda c: c in letters, 1, 1)

    def maybe(self, letter: str) -> bool:
        return bool(self.run(lambda c: c == letter, 0, 1))

    def word_ends(self) -> None:
        if self.at < len(self.text) and _in_word(self.text[self.at]):
            raise ValueError(f"at {self.at}")


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _database_form(text: str, start: int) -> dict:
    """T0262_.09.0001c19: work, perhaps a volume after a point (or an underscore and a point), page, register, line."""
    work_digits, volume_digits, page_digits, line_digits = DATABASE_DIGITS
    r = _Reader(text, start + len(COLLECTION))
    out = {"form": "sat", "work": COLLECTION + r.run(_digit, work_digits, work_digits), "volume": None}
    underscored = r.maybe("_")
    r.one_of(".")
    first = r.run(_digit, 1, page_digits)
    if len(first) == volume_digits:
        out["volume"] = int(first)
        r.one_of(".")
        first = r.run(_digit, page_digits, page_digits)
    elif underscored or len(first) != page_digits:
        raise ValueError("no page")
    out |= {"page": int(first), "register": r.one_of(REGISTERS), "line": r.number(line_digits, line_digits), "from_foot": False}
    r.word_ends()
    return out | {"end": r.at}


def _printed_form(text: str, start: int) -> dict:
    """T. 262, 27b-1: work, a separator, page, register, perhaps a sign that lines count from the foot, line."""
    r = _Reader(text, start + len(COLLECTION))
    r.maybe(".")
    r.run(str.isspace, 0, len(text))
    work = r.run(_digit, 1, 4)
    r.run(lambda c: c.isspace() or c in ",.:;", 1, len(text))
    out = {"form": "print", "work": COLLECTION + work.zfill(4), "page": r.number(1, 3), "register": r.one_of(REGISTERS), "from_foot": r.maybe("-"), "line": r.number(1, 2)}
    r.word_ends()
    return out | {"end": r.at}


def _segment_form(text: str, colon: int) -> dict:
    """pli-tv-bu-vb-pj1:2.3: a lower-case name with a number before its first point, a colon, two or more numbers with points."""
    begin = colon
    while begin and (text[begin - 1].isascii() and (text[begin - 1].islower() or _digit(text[begin - 1])) or text[begin - 1] in ".-"):
        begin -= 1
    for start in range(begin, colon):
        name = text[start:colon]
        if name[0].isalpha() and not (start and _in_word(text[start - 1])) and any(map(_digit, name.partition(".")[0])):
            break
    else:
        raise ValueError("no name")
    r = _Reader(text, colon + 1)
    ends = [r.at + len(r.run(_digit, 1, len(text)))]
    while r.at + 1 < len(text) and text[r.at] == "." and _digit(text[r.at + 1]):
        r.at += 1
        r.run(_digit, 1, len(text))
        ends.append(r.at)
    if r.at < len(text) and _in_word(text[r.at]):
        ends.pop()  # the last number runs on as a word
    if len(ends) < 2:
        raise ValueError("no segment")
    return {"form": "sutta", "start": start, "work": name, "segment": text[colon + 1 : ends[-1]], "from_foot": False, "end": ends[-1]}


def citations_in(text: str) -> list[dict]:
    """Every foreign citation of one text with its place; of overlapping ones the earliest, then the longest, stands."""
    found = []
    for i, c in enumerate(text):
        forms = (_segment_form,) if c == ":" else (_database_form, _printed_form) if c == COLLECTION and not (i and _in_word(text[i - 1])) else ()
        for form in forms:
            try:
                found.append({"start": i, "volume": None, "page": None, "register": None, "line": None, "segment": None} | form(text, i))
            except ValueError:
                pass
    out: list[dict] = []
    for c in sorted(found, key=lambda c: (c["start"], -c["end"], c["form"])):
        if not out or c["start"] >= out[-1]["end"]:
            out.append(c)
    return out


def foreign_citations(texts: DataFrame) -> DataFrame:
    """doc_id and each foreign citation with its place. Choosing is sequential within one text, so it runs on Arrow batches."""
    fields = T.StructType([T.StructField(n, {"long": T.LongType(), "boolean": T.BooleanType()}.get(k, T.StringType())) for n, k in (x.split(" ") for x in OCCURRENCE.split(", "))])

    @F.pandas_udf(T.ArrayType(fields))
    def scanned(text: pd.Series) -> pd.Series:
        return text.map(lambda t: citations_in(t or ""))

    return texts.select("doc_id", F.explode(scanned("text")).alias("c")).select("doc_id", "c.*")


def address_to_urn(addresses: DataFrame, lines: DataFrame) -> DataFrame:
    """id, urn, problem of addresses (id, volume, page, register, line, from_foot) in an index of lines (urn, volume, page, register,
    line). Lines counted from the foot start at the register's last; an address with several texts is refused."""
    place = ["volume", "page", "register"]
    # the texts of a place are counted before they are met, so a crowded place costs its addresses and its lines, not their product
    index = lines.groupBy(*place, "line").agg(F.count("urn").alias("n"), F.min("urn").alias("urn"))
    last = index.groupBy(*place).agg(F.max("line").alias("last"))
    want = addresses.join(last, place, "left").withColumn("line", F.when(F.col("from_foot"), F.col("last") - F.col("line") + 1).otherwise(F.col("line")))
    hit = want.join(index, [*place, "line"], "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("urn").alias("urn"))
    return hit.select("id", F.when(F.col("n") == 1, F.col("urn")).alias("urn"), F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").alias("problem"))


def rewritten(text: Column, foreign: Column, urn: Column) -> Column:
    """The text with a foreign citation replaced, but not inside a quotation by any of the pairs of marks.

    Quotations and what lies between them alternate: the pieces between are those that no quotation's pattern matches."""
    quoted = "|".join(f"{a}[^{b}]*{b}" for a, b in QUOTES.items())
    outside, inside = F.split(text, quoted), F.regexp_extract_all(text, F.lit(f"({quoted})"), 1)
    return F.array_join(F.transform(outside, lambda p, i: F.concat(F.replace(p, foreign, urn), F.coalesce(F.get(inside, i), F.lit("")))), "")


def quote_in_source(quote: Column, source: Column) -> Column:
    """Place (from 0) of a quote that stands exactly once in a source, else null."""
    at = F.call_function("locate", quote, source)
    again = F.call_function("locate", quote, source, at + 1)
    return F.when((F.length(quote) > 0) & (at > 0) & (again == 0), at - 1)


#: Letters of roman numerals.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def volpage(anchor: Column) -> Column:
    """volume, first, last of anchors such as 'S iii 12-15': roman volume and page range; null where it isn't one."""
    p = r"^\s*[A-Za-z]+\s+([ivxlc]+)\s+(\d+)(?:\s*[-–]\s*(\d+))?\s*$"
    roman = F.split(F.regexp_extract(anchor, p, 1), "")
    value = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), c), F.lit(0))
    volume = F.aggregate(roman, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("before")), lambda a, c: F.struct((a["sum"] + value(c) - F.when(a["before"] < value(c), 2 * a["before"]).otherwise(0)).alias("sum"), value(c).alias("before")), lambda a: a["sum"])
    first = F.regexp_extract(anchor, p, 2)
    last = F.regexp_extract(anchor, p, 3)
    return F.when(anchor.rlike(p), F.struct(volume.alias("volume"), F.try_to_number(first, F.lit("99999")).cast("int").alias("first"), F.try_to_number(F.when(last == "", first).otherwise(last), F.lit("99999")).cast("int").alias("last")))


def flatten_parallels(rows: DataFrame) -> DataFrame:
    """a, b, relation, partial of nested maps (uid, parallels map<string,array<string>>); a leading ~ marks a partial one."""
    each = rows.select("uid", F.explode("parallels").alias("relation", "others")).select(F.col("uid").alias("a"), "relation", F.explode("others").alias("b"))
    return each.select("a", F.regexp_replace("b", "^~", "").alias("b"), "relation", F.col("b").startswith("~").alias("partial")).dropDuplicates(["a", "b", "relation"])


#: Suffixes of Tibetan titles, of which the first that fits counts, and how deep a commentary they name (0: a root).
GENRES = {"རྒྱ་ཆེར་འགྲེལ་པ": 1, "རྒྱ་ཆེར་འགྲེལ": 1, "རྒྱ་ཆེར་བཤད་པ": 1, "རྣམ་པར་བཤད་པ": 1, "འགྲེལ་བཤད": 2, "དཀའ་འགྲེལ": 1, "འགྲེལ་པ": 1, "བཤད་པ": 1, "ཚིག་ལེའུར་བྱས་པ": 0, "ཚིག་ལེའུར་བྱས": 0}
#: Words of ritual titles, which name no commentary; "called" at a title's end; genitives before a suffix.
RITUAL = ["སྒྲུབ་ཐབས", "ཆོ་ག", "བསྟོད་པ", "སྔགས", "མན་ངག"]
CALLED, GENITIVE, TAIL = "(་?(ཞེས|ཅེས|ཞེའོ)་བྱ་བ)+$", "་?(གྱི|ཀྱི|གི|ཡི|འི)$", "[།་ ]+$"


def _plain(title: Column) -> Column:
    """Without a genitive and separators at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, TAIL, ""), GENITIVE, ""), TAIL, ""))


def genre(titles: DataFrame) -> DataFrame:
    """The rows of titles with stem, genre, depth, comparable: the first suffix of GENRES that a title ends in, cut off; the
    comparable title as stem, and depth 0, where there is none or the title is a ritual's."""
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace("title", TAIL, ""), CALLED, ""), TAIL, "")
    cut = lambda whole, end: _plain(F.substring(whole, F.lit(1), F.length(whole) - F.length(end)))
    forms = F.array(*[F.struct(F.lit(g).alias("genre"), F.lit(depth).alias("depth")) for g, depth in GENRES.items()])
    fits = F.filter(forms, lambda x: F.endswith("_bare", x["genre"]) & (cut(F.col("_bare"), x["genre"]) != ""))
    rows = titles.withColumn("_bare", title).withColumn("_fit", F.when(~F.col("_bare").rlike("|".join(RITUAL)), F.get(fits, F.lit(0))))
    stem = cut(F.col("_bare"), F.coalesce("_fit.genre", F.lit("")))
    return rows.select(*titles.columns, stem.alias("stem"), F.col("_fit.genre").alias("genre"), F.coalesce("_fit.depth", F.lit(0)).alias("depth"), _plain(F.col("_bare")).alias("comparable"))


def genre_relations(titles: DataFrame) -> DataFrame:
    """work, parent, title, explains, relation, confidence: the parents of each work whose title names a genre, all of equally
    good ones. Without a column work, a title is its own work.

    A parent has the longest other title that the stem extends, found by equality with the stem's prefixes; failing that, it is
    among the nearest less deep works of the same stem. Where the longest is the family's bare stem, a nearer commentary of the
    family goes before it. A parent that is a commentary makes a subcommentary; several parents are uncertain."""
    work = F.col("work") if "work" in titles.columns else F.col("title")
    works = genre(titles.select(work.alias("work"), "title").where("title is not null").distinct())
    # what a work is found by: its title (layer -1), and its family and depth
    own = F.explode(F.array(F.struct(F.lit(-1).alias("layer"), F.col("comparable").alias("key")), F.struct(F.col("depth").alias("layer"), F.col("stem").alias("key"))))
    index = works.withColumn("at", own).select("at.*", F.col("work").alias("parent"), F.col("title").alias("explains"), F.col("genre").alias("of"), F.col("depth").alias("level"))
    held = index.groupBy("layer", "key").agg(F.max("of").isNotNull().alias("named"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("stem")), lambda n: F.struct(F.lit(-1).alias("layer"), F.substring("stem", F.lit(1), n).alias("key")))
    family = F.transform(F.filter(F.sequence(F.lit(0), F.lit(max(GENRES.values()))), lambda d: d < F.col("depth")), lambda d: F.struct(d.alias("layer"), F.col("stem").alias("key")))
    asks = works.where("genre is not null").select("work", "title", "stem", "comparable", F.explode(F.concat(prefixes, family)).alias("at")).select("*", "at.*")
    found = asks.join(held, ["layer", "key"]).where("layer >= 0 or key <> comparable")
    longest = F.max_by(F.struct("key", "named"), F.when(F.col("layer") < 0, F.length("key")))
    best = found.groupBy("work", "title", "stem").agg(longest.alias("longest"), F.max(F.when(F.col("layer") >= 0, F.col("layer"))).alias("nearest"))
    by_family = F.col("longest").isNull() | ((F.col("longest.key") == F.col("stem")) & ~F.col("longest.named") & (F.coalesce("nearest", F.lit(0)) >= 1))
    chosen = best.select("work", "title", F.when(by_family, F.col("nearest")).otherwise(F.lit(-1)).alias("layer"), F.when(by_family, F.col("stem")).otherwise(F.col("longest.key")).alias("key"))
    pairs = chosen.join(index, ["layer", "key"]).withColumn("several", F.count("*").over(W.partitionBy("work")) > 1)
    relation = F.when(F.col("of").isNotNull() & (F.col("level") >= 1), "subcommentary_of").otherwise("comments_on")
    return pairs.select("work", "parent", "title", "explains", relation.alias("relation"), F.when(F.col("several"), "uncertain").otherwise("probable").alias("confidence"))


#: Tone marks of pinyin in order of the tones.
TONES = {1: "̄", 2: "́", 3: "̌", 4: "̀"}


def pinyin_mark(syllable: str) -> str:
    """'lv3' -> 'lǚ': the mark goes on a or e, on the o of ou, else on the last vowel."""
    if not syllable or not syllable[-1].isdigit():
        return syllable
    base, tone = syllable[:-1].replace("u:", "ü").replace("v", "ü"), int(syllable[-1])
    if tone not in TONES:
        return base
    vowels = [i for i, c in enumerate(base) if c in "aeiouü"]
    at = next((base.index(v) for v in "ae" if v in base), base.index("o") if "ou" in base else vowels[-1] if vowels else None)
    return base if at is None else unicodedata.normalize("NFC", base[: at + 1] + TONES[tone] + base[at + 1 :])


def toneless(reading: Column) -> Column:
    """A reading without tone marks or digits; ü stays."""

    @F.pandas_udf(T.StringType())
    def bare(s: pd.Series) -> pd.Series:
        drop = set(TONES.values())
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if c not in drop and not c.isdigit())))

    return bare(reading)


def toned(reading: Column) -> Column:
    """Numbered pinyin ('zhong1 guo2') with tone marks."""

    @F.pandas_udf(T.StringType())
    def marked(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(map(pinyin_mark, x.split(" "))))

    return marked(reading)


PLACES = "array<struct<n:long,start:long,how:string>>"


def _aligned(text: str, passages: list[dict]) -> list[tuple[int, int, str]]:
    """(n, start, how) of one work's passages in order."""
    cursor, at = 0, np.full(len(passages), -1.0)
    for i, p in enumerate(passages):
        if p["text"] and (found := text.find(p["text"], cursor)) >= 0:
            at[i], cursor = found, found + len(p["text"])
    exact = np.flatnonzero(at >= 0)
    how = np.full(len(at), "none", object)
    if len(exact):
        first, last = exact[0], exact[-1] + 1
        at[first:last] = np.interp(np.arange(first, last), exact, at[exact])
        how[first:last] = "interpolated"
        how[exact] = "exact"
    return list(zip((p["n"] for p in passages), at.astype(np.int64).tolist(), how, strict=True))


def cursor_alignment(passages: DataFrame, targets: DataFrame) -> DataFrame:
    """work, n, start, how: places of numbered passages (work, n, text) in their work's text (work, text), in order.

    A passage found after the last one is exact and moves the cursor; one that isn't takes a place spaced evenly between its
    neighbours (interpolated). Order makes this sequential within a work, so a work's passages are one row; rows go in Arrow batches. Of
    several texts of a work the least stands."""

    @F.arrow_udf(PLACES)
    def align(text: pa.Array, held: pa.Array) -> pa.Array:
        rows = [[dict(zip(("n", "start", "how"), x, strict=True)) for x in _aligned(t.as_py() or "", h.as_py())] for t, h in zip(text, held, strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("n", pa.int64()), ("start", pa.int64()), ("how", pa.string())])))

    share_package(passages.sparkSession)
    # both go to the work's place in one exchange, before anything is aggregated
    none, passage = F.lit(None).cast("string"), F.struct(F.col("n").cast("long").alias("n"), "text")
    rows = passages.select("work", passage.alias("passage"), none.alias("whole")).unionByName(targets.select("work", F.lit(None).cast("struct<n:long,text:string>").alias("passage"), F.col("text").alias("whole")))
    both = rows.repartition("work").groupBy("work").agg(F.sort_array(F.collect_list("passage")).alias("held"), F.min("whole").alias("text"))
    placed = both.where(F.size("held") > 0).select("work", F.explode(align("text", "held")).alias("p"))
    return placed.select(F.col("work").cast("string").alias("work"), "p.n", "p.start", "p.how")


def covered_renderings(renderings: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """text_id, chunk_no, text of chunks at least `least` of whose ordinals have a rendering (text_id, first, last, reading_order,
    text): the renderings that reach into a chunk, in order, joined by spaces."""
    hit = renderings.join(chunks, "text_id").where((F.col("last") >= F.col("first_ordinal")) & (F.col("first") <= F.col("last_ordinal")))
    inside = F.explode(F.sequence(F.greatest("first", "first_ordinal"), F.least("last", "last_ordinal")))
    covered = hit.select("text_id", "chunk_no", "first_ordinal", "last_ordinal", inside.alias("o")).groupBy("text_id", "chunk_no").agg((F.count_distinct("o") / (F.first("last_ordinal") - F.first("first_ordinal") + 1)).alias("share"))
    joined = hit.groupBy("text_id", "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "reading_order", "last", "text"))), lambda x: x["text"]), " ").alias("text"))
    return joined.join(covered.where(F.col("share") >= least).select("text_id", "chunk_no"), ["text_id", "chunk_no"])
