"""Repairs of citations, occurrence by occurrence: what a text asserts wrongly is corrected, taken out, or flagged; nothing is invented.

A text's occurrences are checked and diagnosed against all segments by joins; what can be proposed for each follows from that.
Then, text by text (texts are bounded by MOST_BYTES), edits that would touch another citation or its quotation are refused, the
edited text is read again, and an edit that would hand its quotation to another citation is refused too."""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folium.functions.text import VARIANTS, fold, strip_punctuation
from folium.operators.evidence import BRACKETS, CITATION, MOST_BYTES, MOST_QUOTED, QUOTES
from folium.operators.reports import blocks
from folium.operators.reuse import find_passages
from folium.session import release, written

#: What is looked at as a citation: anything that begins as an address, with a generated translation's mark, well formed or not.
ANY_CITATION = r"(?<![a-z])[a-z]+\d*:\d+@[A-Za-z0-9]+(?:-[A-Za-z0-9]+)?(?:#tr:[A-Za-z0-9/:._-]*[A-Za-z0-9])?"
WRAPPERS = BRACKETS | {"【": "】"}
#: Characters of the shortest quotation that is looked for elsewhere, and how many places are named.
SHORTEST, NAMED = 4, 3
OCCURRENCE = "struct<k:long,urn:string,urn_start:long,urn_end:long,quoted:string,quote_start:long,quote_end:long,cite_start:long,cite_end:long,unpaired:boolean>"
ACTION = "k:long,urn:string,state:string,reason:string,replaced_urn:string"
EDIT = "start:long,end:long,before:string,after:string"
_FOLD = {c: group[0] for group in VARIANTS for c in group[1:]}


def found_in(text: str) -> list[dict]:
    """Citations in the prose of a text with the places (characters) of the address, the quotation right before it, and what would go with
    it (its brackets); unpaired: only one of them is there."""
    out = []
    for begin, end in blocks(text)[0]:
        for m in re.finditer(ANY_CITATION, text[begin:end]):
            a, b = m.start() + begin, m.end() + begin
            opening, closing = text[a - 1] if a > begin else "", text[b] if b < end else ""
            wrapped = WRAPPERS.get(opening) == closing and closing != ""
            before = text[begin : a - 1 if wrapped or opening in WRAPPERS else a].rstrip(" ")
            quote = None
            if before and before[-1] in QUOTES.values():
                mark = next(x for x, y in QUOTES.items() if y == before[-1])
                at = before.rfind(mark, 0, len(before) - 1)
                if 0 <= at and 0 < len(before) - at - 2 <= MOST_QUOTED:
                    quote = begin + at + 1, begin + len(before) - 1
            out.append({
                "k": len(out), "urn": m[0], "urn_start": a, "urn_end": b, "quoted": text[slice(*quote)] if quote else None, "quote_start": quote[0] if quote else None, "quote_end": quote[1] if quote else None,
                "cite_start": a - wrapped, "cite_end": b + wrapped, "unpaired": not wrapped and (opening in WRAPPERS or closing in WRAPPERS.values()),
            })
    return out


def _edges(lost: DataFrame, segments: DataFrame) -> DataFrame:
    """_urn, _needle, spans of lost quotations: whether one crosses from its line into a neighbour, and lies in no neighbour whole.

    Neighbours are named by a window over addresses alone; of each only what a quotation may reach into goes on."""
    w = W.partitionBy("doc_id").orderBy("ordinal")
    u = F.col("urn")
    named = segments.select(u.alias("_urn"), F.array(*[F.struct(F.lit(at).alias("at"), x.alias("urn")) for at, x in ((-1, F.lag(u).over(w)), (1, F.lead(u).over(w)), (2, F.lead(u, 2).over(w)))]).alias("near"))
    ends = F.left("_bare", F.length("_needle")).alias("_first"), F.right("_bare", F.length("_needle")).alias("_last")
    key = ["_urn", "_needle", "_first", "_last"]
    asked = lost.select("_urn", "_needle", *ends).distinct().join(named, "_urn").select(*key, F.explode("near").alias("n")).select(*key, "n.*").where("urn is not null")
    both = asked.join(segments.select("urn", "content"), "urn").withColumn("line", strip_punctuation("content"))
    reach = F.length("_needle")
    side = lambda at, x: F.coalesce(F.max(F.when(F.col("at") == at, x)), F.lit(""))
    head, tail = F.left("line", reach), F.right("line", reach)
    near = both.groupBy(*key).agg(side(-1, tail).alias("b1"), side(1, head).alias("a1"), side(1, tail).alias("e1"), side(2, head).alias("a2"), F.max(F.contains("line", "_needle")).alias("alone"))
    over = F.concat("b1", "_first"), F.concat("_last", F.left(F.concat("a1", "a2"), reach)), F.concat("e1", "a2")
    across = F.lit(False)
    for x in over:
        across = across | F.contains(x, F.col("_needle"))
    return near.select("_urn", "_needle", (across & ~F.col("alone")).alias("spans"))


def diagnosed(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """claims (urn, quoted) with verdict, reason, actual, found_at, replacement: one ladder.

    verdict: bad_urn, not_citable_as_source (a generated translation), not_found, existence_only, ok, quote_mismatch. reason of a mismatch:
    empty_quote, editorial_punctuation, orthographic_variant (actual: the line itself), spans_line_boundary (it crosses into a neighbour
    and lies in no one line), wrong_address (found_at: the first NAMED places that hold it but for punctuation; replacement: what the
    only one holds), not_found_in_search, or search_unavailable for a quotation too short to look for. segments: urn, doc_id, ordinal,
    content. Claims meet their lines once and are written, so what is left to do is done for the lost ones alone."""
    spark = claims.sparkSession
    base = F.split_part("urn", F.lit("#"), F.lit(1))
    rows = claims.withColumn("_urn", base).join(segments.select(F.col("urn").alias("_urn"), F.col("content").alias("actual")), "_urn", "left")
    quote = F.trim(F.coalesce("quoted", F.lit("")))
    verdict = F.when(~F.col("_urn").rlike(f"^{CITATION}$"), "bad_urn").when(F.contains("urn", F.lit("#tr:")), "not_citable_as_source").when(F.col("actual").isNull(), "not_found").when(F.col("quoted").isNull(), "existence_only").when((quote != "") & F.contains("actual", quote), "ok").otherwise("quote_mismatch")
    rows = rows.withColumn("verdict", verdict)
    mismatch = F.col("verdict") == "quote_mismatch"
    rows = rows.withColumn("_needle", F.when(mismatch, strip_punctuation(quote))).withColumn("_bare", F.when(mismatch, strip_punctuation("actual")))
    here = F.when(F.col("_needle") == "", "empty_quote").when(F.contains("_bare", "_needle"), "editorial_punctuation").when(F.contains(fold(F.col("_bare")), fold(F.col("_needle"))), "orthographic_variant")
    rows = rows.withColumn("reason", F.when(mismatch, here))
    lost = mismatch & F.col("reason").isNull()
    rows = rows.withColumn("_lost", lost).withColumn("_bare", F.when(lost, F.col("_bare"))).withColumn("actual", F.when(F.col("reason").isin("editorial_punctuation", "orthographic_variant"), F.col("actual")))
    rows = written(rows, "claims")
    release(spark)
    lost = rows.where("_lost")
    edges = _edges(lost, segments)
    wanted = lost.where(F.length("_needle") >= SHORTEST).select(F.col("_needle").alias("item_id"), F.col("_needle").alias("text")).distinct()
    held = segments.select(F.struct("doc_id", "ordinal", "urn").alias("doc_id"), strip_punctuation(F.coalesce("content", F.lit(""))).alias("text"))
    places = find_passages(wanted, held, SHORTEST).groupBy(F.col("item_id").alias("_needle")).agg(F.slice(F.sort_array(F.collect_set("doc_id")), 1, NAMED).alias("places"))
    places = places.select("_needle", F.transform("places", lambda p: p["urn"]).alias("found_at"))
    only = places.where(F.size("found_at") == 1).select("_needle", F.get("found_at", F.lit(0)).alias("urn")).join(segments.select("urn", "content"), "urn").select("_needle", F.col("content").alias("replacement"))
    found = lost.join(edges, ["_urn", "_needle"], "left").join(places, "_needle", "left").join(only, "_needle", "left")
    spans = F.coalesce("spans", F.lit(False))
    reason = F.when(spans, "spans_line_boundary").when(F.col("found_at").isNotNull(), "wrong_address").when(F.length("_needle") < SHORTEST, "search_unavailable").otherwise("not_found_in_search")
    columns = [*claims.columns, "verdict"]
    elsewhere = lambda c: F.when(~spans, F.col(c)).alias(c)
    found = written(found.select(*columns, reason.alias("reason"), "actual", elsewhere("found_at"), elsewhere("replacement")), "lost")
    del edges, places, only
    release(spark)
    return found.unionByName(rows.where("not _lost").select(*columns, "reason", "actual"), allowMissingColumns=True)


def _bare(c: str, folded: bool) -> str:
    if unicodedata.category(c)[0] in "PSZ" or c.isspace():
        return ""
    return _FOLD.get(c, c) if folded else c


def aligned_quote(actual: str, quoted: str, folded: bool) -> tuple[str | None, str | None]:
    """(the part of a line that a quotation stands for, None), or (None, why there is none): it must occur once, but for punctuation (and
    variants). A whole line keeps its own marks around; a part is cut at its first and last letter."""
    needle = "".join(_bare(c, folded) for c in quoted)
    if not needle:
        return None, "empty_quote"
    kept = [(i, b) for i, c in enumerate(actual) if (b := _bare(c, folded))]
    line = "".join(b for _, b in kept)
    at = line.find(needle)
    if at < 0:
        return None, "unaligned_quote"
    if line.find(needle, at + 1) >= 0:
        return None, "ambiguous_quote"
    if line == needle:
        return actual.strip(), None
    return actual[kept[at][0] : kept[at + len(needle) - 1][0] + 1], None


def _planned(f: dict) -> dict:
    """The action for one diagnosed occurrence, with the edit it asks for."""
    out = {"k": f["k"], "urn": f["urn"], "state": "flagged", "reason": f["reason"], "replaced_urn": None, "edit": None, "now": f["quoted"]}
    verdict, reason, found = f["verdict"], f["reason"], list(f["found_at"] if f["found_at"] is not None else [])
    if f["unpaired"] and verdict not in ("ok", "existence_only"):
        return out | {"reason": "unpaired_wrapper"}
    if verdict in ("ok", "existence_only"):
        return out | {"state": "verified" if verdict == "ok" else "existence_only", "reason": None}
    if verdict == "not_citable_as_source":
        return out | {"reason": verdict}
    if reason in ("editorial_punctuation", "orthographic_variant"):
        now, refusal = aligned_quote(f["actual"], f["quoted"], reason == "orthographic_variant")
        return out | ({"reason": refusal} if now is None else {"state": "quote_relaxed", "edit": (f["quote_start"], f["quote_end"], now), "now": now})
    if reason == "wrong_address":
        if len(found) > 1:
            return out | {"reason": "ambiguous"}
        if f["quoted"].strip() not in (f["replacement"] or ""):
            return out | {"reason": "replacement_not_exact"}
        return out | {"state": "citation_corrected", "replaced_urn": found[0], "edit": (f["urn_start"], f["urn_end"], found[0])}
    if verdict in ("not_found", "bad_urn") or reason == "not_found_in_search":
        return out | {"state": "no_sources", "reason": reason or verdict, "edit": (f["cite_start"], f["cite_end"], "")}
    return out


def _touching(plans: list[dict], found: list[dict]) -> set[int]:
    """Occurrences of which an edit overlaps another's citation or quotation, or whose own are overlapped by another's edit."""
    spans = [(p["edit"][0], p["edit"][1], True, p["k"]) for p in plans if p["edit"]]
    spans += [(f[f"{x}_start"], f[f"{x}_end"], False, f["k"]) for f in found for x in ("quote", "cite") if f[f"{x}_start"] is not None]
    hit: set[int] = set()
    open_: list[tuple[int, bool, int]] = []
    for start, end, writes, k in sorted(spans):
        while open_ and open_[0][0] <= start:
            heapq.heappop(open_)
        for _, other_writes, other in open_:
            if other != k and (writes or other_writes) and start < end:
                hit |= {k, other}
        heapq.heappush(open_, (end, writes, k))
    return hit


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def _rebound(text: str, plans: list[dict], found: list[dict]) -> set[int]:
    """Occurrences whose removal would leave their quotation to another citation, as the edited text is read."""
    edits = sorted(p["edit"] for p in plans if p["edit"])
    moved = lambda at: at + sum(len(new) - (end - start) for start, end, new in edits if end <= at)
    actual = {f["urn_start"]: f for f in found_in(edited(text, edits))}
    removed = [(p, f) for p, f in zip(plans, found, strict=True) if p["edit"] and p["state"] == "no_sources"]
    owners = {moved(f["quote_start"]): p["k"] for p, f in removed if f["quote_start"] is not None}
    gone, out = {p["k"] for p, _ in removed}, set()
    for p, f in zip(plans, found, strict=True):
        now = actual.get(moved(f["urn_start"]))
        if p["k"] not in gone and now is not None and now["quoted"] != p["now"] and now["quote_start"] in owners:
            out.add(owners[now["quote_start"]])
    return out


def repaired_text(text: str, found: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """(text, actions, edits) of one text from its diagnosed occurrences, in order."""
    columns = ("k", "urn", "state", "reason", "replaced_urn")
    plans = [_planned(f) for f in found]
    if not any(p["edit"] for p in plans):
        return text, [{c: p[c] for c in columns} for p in plans], []
    for refused, reason in ((_touching, "overlapping_edits"), (lambda p, f: _rebound(text, p, f), "citation_rebinding")):
        for k in refused(plans, found):
            plans[k] |= {"state": "flagged", "reason": reason, "replaced_urn": None, "edit": None, "now": found[k]["quoted"]}
    edits = [p["edit"] for p in plans if p["edit"]]
    actions = [{c: p[c] for c in columns} for p in plans]
    return edited(text, edits), actions, [{"start": a, "end": b, "before": text[a:b], "after": new} for a, b, new in edits]


def occurrences(texts: DataFrame) -> DataFrame:
    """doc_id and each citation in the prose of texts (doc_id, text), well formed or not."""
    found = F.pandas_udf(lambda t: t.map(lambda x: found_in(x or "")), f"array<{OCCURRENCE}>")
    return texts.select("doc_id", F.explode(found("text")).alias("o")).select("doc_id", "o.*")


def repair(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, text, repaired, refusal, actions (k, urn, state, reason, replaced_urn), edits (start, end, before, after) of every text.

    state: verified, existence_only, quote_relaxed (the quotation becomes what is printed), citation_corrected (the one place that holds
    it exactly), no_sources (the citation goes, the prose stays), flagged (nothing is changed, for the reason given). A text of more
    than MOST_BYTES is refused whole."""
    sized = texts.select("doc_id", "text", (F.octet_length("text") > MOST_BYTES).alias("large"))
    checked = diagnosed(occurrences(sized.where("not large")), segments)
    columns = [c for c in checked.columns if c != "doc_id"]
    found = checked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", *[c for c in columns if c != "k"]))).alias("found"))

    def done(text: pa.Array, found: pa.Array) -> pa.Array:
        rows = [repaired_text(t or "", f or []) for t, f in zip(text.to_pylist(), found.to_pylist(), strict=True)]
        return pa.array([dict(zip(("text", "actions", "edits"), r, strict=True)) for r in rows], to_arrow_type(result))

    result = T.StructType.fromDDL(f"text string, actions array<struct<{ACTION}>>, edits array<struct<{EDIT}>>")
    done = F.arrow_udf(done, result)

    rows = sized.join(found, "doc_id", "left").withColumn("r", done("text", "found"))
    refusal: Column = F.when(F.col("large"), "too_large")
    out = F.when(F.coalesce("large", F.lit(False)) | F.col("text").isNull(), F.col("text")).otherwise(F.col("r.text"))
    return rows.select("doc_id", out.alias("text"), (F.size("r.edits") > 0).alias("repaired"), refusal.alias("refusal"), F.col("r.actions").alias("actions"), F.col("r.edits").alias("edits"))
