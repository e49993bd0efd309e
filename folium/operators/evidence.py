"""Citations: extraction, verification against texts, diagnosis of failures, conflicts of edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import fold, strip_punctuation
from folium.operators.reuse import find_passages

CITATION = r"[a-z]+\d*:\d+@l\d+(?:-l\d+)?"
MOST_BYTES = 200_000
#: Characters of the longest quotation that a citation takes.
MOST_QUOTED = 400


def extract(text: Column) -> Column:
    """Distinct citations of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))


def verify(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Claims (claim_id, urn, quote) with verdict: bad_urn, not_found, existence_only, ok or quote_mismatch.

    One join on the address for all claims; segments have urn, content."""
    held = segments.select("urn", F.col("content").alias("held"))
    both = claims.join(held, "urn", "left")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    verdict = F.when(~F.coalesce(F.col("urn"), F.lit("")).rlike(f"^{CITATION}$"), "bad_urn").when(F.col("held").isNull(), "not_found").when(quote == "", "existence_only").when(F.contains("held", quote), "ok").otherwise("quote_mismatch")
    return both.select("claim_id", "urn", verdict.alias("verdict"))


def diagnose(failed: DataFrame, segments: DataFrame) -> DataFrame:
    """claim_id, reason why a quote isn't in the cited segment (claim_id, doc_id, ordinal, quote): punctuation, variant,
    boundary (it runs into a neighbour), elsewhere in the document, or absent."""
    w = W.partitionBy("doc_id").orderBy("ordinal")
    around = segments.withColumn("wide", F.concat_ws("", F.lag("content").over(w), "content", F.lead("content").over(w)))
    both = failed.join(around.select("doc_id", "ordinal", "content", "wide"), ["doc_id", "ordinal"])
    anywhere = failed.join(segments.select("doc_id", F.col("content").alias("other")), "doc_id").where(F.contains("other", "quote")).select("claim_id", F.lit(1).alias("seen")).distinct()
    q = F.col("quote")
    reason = (
        F.when(strip_punctuation(q) == "", "empty").when(F.contains(strip_punctuation(F.col("content")), strip_punctuation(q)), "punctuation").when(F.contains(fold(F.col("content")), fold(q)), "variant")
        .when(F.contains("wide", q), "boundary").when(F.col("seen").isNotNull(), "elsewhere").otherwise("absent")
    )
    return both.join(anywhere, "claim_id", "left").select("claim_id", reason.alias("reason"))


def misplaced(quotes: DataFrame, segments: DataFrame, shortest: int = 12) -> DataFrame:
    """quote_id, reason, doc_id, ordinal of quotes (quote_id, quote) that their own address doesn't hold: wrong_address with the first place in
    the corpus that does, not_found, or too_short to look for. Places are met by the quote's first characters, not by comparing all."""
    long = quotes.where(F.length("quote") >= shortest).select(F.col("quote_id").alias("item_id"), F.col("quote").alias("text"))
    held = segments.select(F.struct("doc_id", "ordinal").alias("doc_id"), F.col("content").alias("text"))
    first = find_passages(long, held, shortest).groupBy(F.col("item_id").alias("quote_id")).agg(F.min("doc_id").alias("place"))
    reason = F.when(F.length("quote") < shortest, "too_short").when(F.col("place").isNull(), "not_found").otherwise("wrong_address")
    return quotes.join(first, "quote_id", "left").select("quote_id", reason.alias("reason"), "place.doc_id", "place.ordinal")


def conflicts(edits: DataFrame) -> DataFrame:
    """doc_id, owner: every owner of whose edit intervals [start, end) one overlaps another owner's. Empty intervals overlap none.

    A document's edits are sorted once. An earlier interval of another owner that reaches past an edit's start is found by two
    running maxima: the furthest end with its owner, and the furthest of ends that were passed by, or passed, another owner's;
    a later one that starts before an edit's end is the next of another owner."""
    w = W.partitionBy("doc_id").orderBy("start", "end", "owner")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    own = F.struct("end", "owner")
    rows = edits.where("start < end").select("doc_id", "owner", "start", "end").withColumn("best", F.max(own).over(before))
    stranger = F.col("best.owner") != F.col("owner")
    rows = rows.withColumn("passed", F.when(stranger, F.least("best.end", "end"))).withColumn("second", F.max("passed").over(before))
    reach = F.when(stranger, F.col("best.end")).otherwise(F.col("second"))
    rows = rows.withColumn("late", F.coalesce(reach > F.col("start"), F.lit(False)))
    rows = rows.withColumn("turn", F.sum(F.coalesce((F.lag("owner").over(w) != F.col("owner")).cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("ahead", F.when(F.lead("turn").over(w) != F.col("turn"), F.lead("start").over(w))).withColumn("next", F.max("ahead").over(W.partitionBy("doc_id", "turn")))
    return rows.where("late or next < end").select("doc_id", "owner").distinct()


def report_status(checked: DataFrame, key: str) -> DataFrame:
    """key, checked, failed, existence_only, status of verified claims."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    rows = checked.groupBy(key).agg(F.count("*").alias("checked"), n(~F.col("verdict").isin("ok", "existence_only")).alias("failed"), n(F.col("verdict") == "existence_only").alias("existence_only"))
    return rows.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("existence_only") == F.col("checked"), "existence_only").otherwise("verified"))


#: Pairs of quotation marks, and of brackets around a citation.
QUOTES = {'"': '"', "“": "”", "「": "」", "『": "』"}
BRACKETS = {"(": ")", "[": "]", "（": "）"}
OCCURRENCES = "array<struct<urn:string,byte_start:long,byte_end:long,quoted:string,quote_start:long,quote_end:long,wrapped:boolean,unpaired:boolean>>"


def _occurrences(text: str | None) -> list[dict]:
    """Every citation of a text with its place in bytes, the quotation right before it, and whether brackets enclose it."""
    text, out, byte = text or "", [], [0]
    for c in text:
        byte.append(byte[-1] + len(c.encode()))
    for m in re.finditer(f"(?<![a-z]){CITATION}", text):  # not from within a run of letters again and again
        start, end = m.span()
        opened = text[start - 1 : start] in BRACKETS and start > 0
        closed = text[end : end + 1] in BRACKETS.values() and end < len(text)
        wrapped = opened and closed and BRACKETS[text[start - 1]] == text[end]
        before = (text[: start - 1] if opened else text[:start]).rstrip(" ")
        quote = None
        if before and before[-1] in QUOTES.values():
            opening = next(a for a, b in QUOTES.items() if b == before[-1])
            at = before.rfind(opening, 0, len(before) - 1)
            if 0 <= at and 0 < len(before) - at - 2 <= MOST_QUOTED:
                quote = at + 1, len(before) - 1
        out.append({"urn": m[0], "byte_start": byte[start], "byte_end": byte[end], "quoted": text[slice(*quote)] if quote else None, "quote_start": byte[quote[0]] if quote else None, "quote_end": byte[quote[1]] if quote else None, "wrapped": wrapped, "unpaired": (opened or closed) and not wrapped})
    return out


def occurrences(texts: DataFrame) -> DataFrame:
    """doc_id, urn, byte_start, byte_end, quoted, quote_start, quote_end, wrapped, unpaired: each citation in each text (doc_id, text).

    Offsets in bytes and pairs of marks are sequential within a text, so texts go in Arrow batches."""
    found = F.pandas_udf(lambda t: t.map(_occurrences), OCCURRENCES)
    return texts.select("doc_id", F.explode(found("text")).alias("o")).select("doc_id", "o.*")


def evidence_roles(foreign: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, start, role of foreign citations (doc_id, start, end, urn): literal inside a quotation (doc_id, quote_start, quote_end), else
    unresolved without an address, else unchecked."""
    inside = foreign.join(quotes.where("quote_start is not null").select("doc_id", "quote_start", "quote_end"), "doc_id").where("start >= quote_start and end <= quote_end").select("doc_id", "start", F.lit(True).alias("inside")).distinct()
    role = F.when(F.col("inside"), "literal").when(F.col("urn").isNull(), "unresolved").otherwise("unchecked")
    return foreign.join(inside, ["doc_id", "start"], "left").select("doc_id", "start", role.alias("role"))
