"""Numbered passages placed in a printed text: windows between the numbers that it prints, then an ordered match within each."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import fold, strip_punctuation

#: Digits as a text prints them, and the brackets that make a number a marker.
DIGITS, OPEN, CLOSE = "〇一二三四五六七八九", "（", "）"
PLACES = "array<struct<n:long,method:string,start:long,end:long,first_ordinal:long,last_ordinal:long>>"


def compared(text: Column) -> Column:
    """The form in which passages and texts are compared: no punctuation or white space, variants as one."""
    return fold(strip_punctuation(text))


def numeral(number: Column) -> Column:
    """A number digit by digit, as markers have it."""
    return F.translate(number.cast("string"), "0123456789", DIGITS)


def marked_windows(lines: DataFrame) -> DataFrame:
    """work, numeral, printed, text, starts, ordinals: what a text (lines: work, ordinal, content) prints from each marker to the next, in
    the compared form, with the places where its lines begin; printed: how often the work has the marker.

    Lines are cut before markers, so a line with several belongs to several windows and none of them needs the whole text."""
    marker = f"{OPEN}([{DIGITS}]+){CLOSE}"
    pieces = lines.select("work", "ordinal", F.posexplode(F.split("content", f"(?={marker})")).alias("piece", "raw"))
    pieces = pieces.withColumn("numeral", F.regexp_extract("raw", f"^{marker}", 1))
    at = W.partitionBy("work").orderBy("ordinal", "piece")
    pieces = pieces.withColumn("window", F.sum((F.col("numeral") != "").cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0))).where("window > 0")
    row = F.sort_array(F.collect_list(F.struct("ordinal", "piece", compared(F.col("raw")).alias("form"))))
    rows = pieces.groupBy("work", "window").agg(F.max("numeral").alias("numeral"), row.alias("rows"))
    lengths = F.transform("rows", lambda r: F.length(r["form"]))
    starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    out = rows.select("work", "numeral", F.array_join(F.transform("rows", lambda r: r["form"]), "").alias("text"), starts.alias("starts"), F.transform("rows", lambda r: r["ordinal"].cast("long")).alias("ordinals"))
    return out.withColumn("printed", F.count("*").over(W.partitionBy("work", "numeral")))


def placed(text: str, starts: list[int], ordinals: list[int], passages: list[tuple[int, str]]) -> list[dict]:
    """Passages (n, form), in order, in one window. One that is found after the last match is exact and moves the cursor. Any other takes
    what lies between the matches around it (interpolated), or has no place where these touch (dropped)."""
    found, cursor = [], 0
    for _, form in passages:
        at = text.find(form, cursor)
        found.append((at, at + len(form)) if at >= 0 else None)
        cursor = at + len(form) if at >= 0 else cursor
    after, ahead = [], len(text)
    for f in reversed(found):
        after.append(ahead)
        ahead = f[0] if f else ahead
    out, behind = [], 0
    for (n, _), f, limit in zip(passages, found, reversed(after), strict=True):
        span = f or ((behind, limit) if limit > behind else None)
        place = {"n": n, "method": "exact" if f else "interpolated" if span else "dropped", "start": None, "end": None, "first_ordinal": None, "last_ordinal": None}
        if span:
            line = lambda offset: ordinals[bisect_right(starts, offset) - 1]
            place |= {"start": span[0], "end": span[1], "first_ordinal": line(span[0]), "last_ordinal": line(max(span[0], span[1] - 1))}
        out.append(place)
        behind = f[1] if f else behind
    return out


def sequential_anchors(passages: DataFrame, lines: DataFrame) -> DataFrame:
    """work, number, n, method, start, end (in the compared form of the number's window), first_ordinal, last_ordinal of passages (work,
    number, n, text). method: exact, interpolated, dropped; no_marker where the work doesn't print the number, and
    ambiguous_marker where it prints it more than once: no window is chosen by chance. Passages that have nothing to compare are left out."""
    forms = passages.select("work", "number", F.col("n").cast("long").alias("n"), compared(F.coalesce("text", F.lit(""))).alias("form")).where("form <> ''")
    asked = forms.groupBy("work", "number").agg(F.sort_array(F.collect_list(F.struct("n", "form"))).alias("passages")).withColumn("numeral", numeral(F.col("number")))
    windows = marked_windows(lines)
    once, printed = windows.where("printed = 1").drop("printed"), windows.groupBy("work", "numeral").agg(F.max("printed").alias("printed"))

    @F.pandas_udf(PLACES)
    def in_windows(text: pd.Series, starts: pd.Series, ordinals: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([placed(t, list(s), list(o), [(p["n"], p["form"]) for p in w]) for t, s, o, w in zip(text, starts, ordinals, wanted, strict=True)])

    hit = asked.join(once, ["work", "numeral"]).select("work", "number", F.explode(in_windows("text", "starts", "ordinals", "passages")).alias("p")).select("work", "number", "p.*")
    state = F.when(F.col("printed").isNull(), "no_marker").when(F.col("printed") > 1, "ambiguous_marker")
    null = lambda name: F.lit(None).cast("long").alias(name)
    miss = asked.join(printed, ["work", "numeral"], "left").withColumn("method", state).where("method is not null")
    miss = miss.select("work", "number", F.explode("passages.n").alias("n"), "method", null("start"), null("end"), null("first_ordinal"), null("last_ordinal"))
    return hit.unionByName(miss)
