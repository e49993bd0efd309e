"""Reports: texts with citations in their prose and records of questions in fenced blocks, which are asked again and compared."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.operators.reuse import find_passages
from folium.session import release, written

#: Fixed value: the word after the fence that opens a record.
FENCE = "replay"
_OPEN, _CLOSE = re.compile(rf" {{0,3}}```{FENCE}[ \t]*\r?"), re.compile(r" {0,3}```[ \t]*\r?")
#: Records of a report that are asked again; each is a query, and a report comes from anyone. The others are refused, not dropped.
MOST_RECORDS = 25
RECORDS = "array<struct<line:long,question:string,arguments:map<string,string>,asserted:map<string,string>,corpus:string,problem:string>>"
Question = Callable[[DataFrame], DataFrame]


def _lines(text: str) -> list[tuple[int, str]]:
    """(place, line) of each line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def blocks(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, str | None]]]:
    """(prose, records): the places of what is prose, and of each record the line of its fence and what it holds (None: it doesn't end).

    A fence ends the prose before it also where its record is never closed; what follows an unclosed record is no prose."""
    prose, records, begin, held = [], [], 0, None
    for number, (at, line) in enumerate(_lines(text), 1):
        if _OPEN.fullmatch(line):
            if begin is not None and begin < at:
                prose.append((begin, at))
            if held is not None:
                records.append((held[0], None))
            begin, held = None, (number, [])
        elif held is not None and _CLOSE.fullmatch(line):
            records.append((held[0], "\n".join(held[1])))
            begin, held = min(at + len(line) + 1, len(text)), None
        elif held is not None:
            held[1].append(line)
    if held is not None:
        records.append((held[0], None))
    if begin is not None and begin < len(text):
        prose.append((begin, len(text)))
    return prose, records


def _plain(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _record(line: int, body: str | None) -> dict:
    out = {"line": line, "question": None, "arguments": None, "asserted": None, "corpus": None, "problem": None}
    if body is None:
        return out | {"problem": "unterminated"}
    try:
        got = json.loads(body)
    except ValueError:
        return out | {"problem": "invalid_json"}
    if not isinstance(got, dict) or not isinstance(got.get("question"), str) or not isinstance(got.get("arguments"), dict):
        return out | {"problem": "missing_question_or_arguments"}
    asserted = got.get("assert", {})
    if not isinstance(asserted, dict):
        return out | {"problem": "invalid_assertions"}
    if not all(part.strip() for path in asserted for part in path.split(".")):
        return out | {"problem": "invalid_assertion_path"}
    corpus = got.get("corpus")
    if corpus is not None and not (isinstance(corpus, str) and corpus.strip()):
        return out | {"problem": "invalid_corpus"}
    strings = lambda d: {k: _plain(v) for k, v in d.items()}
    return out | {"question": got["question"], "arguments": strings(got["arguments"]), "asserted": strings(asserted), "corpus": corpus}


def records(reports: DataFrame) -> DataFrame:
    """doc_id, line, question, arguments, asserted, corpus, problem of every record in reports (doc_id, text). One that can't be read is
    returned with its problem: a claim that nobody can parse is one that nobody has checked."""
    found = F.pandas_udf(lambda t: t.map(lambda x: [_record(*r) for r in blocks(x or "")[1]]), RECORDS)
    return reports.select("doc_id", F.explode(found("text")).alias("r")).select("doc_id", "r.*")


def prose(reports: DataFrame) -> DataFrame:
    """doc_id, start, end: the places of the prose of reports."""
    found = F.pandas_udf(lambda t: t.map(lambda x: [{"start": a, "end": b} for a, b in blocks(x or "")[0]]), "array<struct<start:long,end:long>>")
    return reports.select("doc_id", F.explode(found("text")).alias("r")).select("doc_id", "r.*")


def replayed(asked: DataFrame, questions: dict[str, Question], corpus: str) -> DataFrame:
    """doc_id, line, status, problem of records. verified: all that it asserts is so; failed: something isn't; executed: it asserts
    nothing; changed: it was made from another corpus; error: the question gave no answer; refused: it can't be read, names no known
    question, or lies beyond the first MOST_RECORDS of its report.

    Each question answers all of its records at once: from (doc_id, line, arguments) it makes rows (doc_id, line, path, value)."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("line"))
    rows = asked.withColumn("_place", place)
    problem = F.coalesce("problem", F.when(~F.col("question").isin(*questions), "unknown_question"), F.when(F.col("_place") > MOST_RECORDS, "too_many_records"))
    rows = written(rows.withColumn("problem", problem), "records")  # read once, whatever the number of questions
    release(asked.sparkSession)
    changed = F.col("problem").isNull() & F.col("corpus").isNotNull() & (F.col("corpus") != corpus)
    live = rows.where(F.col("problem").isNull() & ~F.coalesce(changed, F.lit(False)))
    answers = None
    for name, answer in questions.items():
        part = answer(live.where(F.col("question") == name).select("doc_id", "line", "arguments")).select("doc_id", "line", "path", F.col("value").cast("string").alias("value"))
        answers = part if answers is None else answers.unionByName(part)
    given = answers.groupBy("doc_id", "line").agg(F.map_from_entries(F.collect_set(F.struct("path", "value"))).alias("given"))
    differs = F.exists(F.map_entries("asserted"), lambda e: ~F.coalesce(F.element_at("given", e["key"]).eqNullSafe(e["value"]), F.lit(False)))
    status = F.when(F.col("problem").isNotNull(), "refused").when(changed, "changed").when(F.col("given").isNull(), "error").when(F.size("asserted") == 0, "executed").when(differs, "failed").otherwise("verified")
    return rows.join(given, ["doc_id", "line"], "left").select("doc_id", "line", status.alias("status"), "problem")


def line_question(segments: DataFrame) -> Question:
    """What an address holds: sha256 and length of the segment (urn, content) of argument `urn`."""

    def answer(asked: DataFrame) -> DataFrame:
        held = segments.select("urn", F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"), F.length("content").alias("length"))  # no content is moved
        hit = asked.select("doc_id", "line", F.element_at("arguments", "urn").alias("urn")).join(held, "urn")
        facts = F.array(F.struct(F.lit("sha256").alias("path"), F.lower(F.hex("sha256")).alias("value")), F.struct(F.lit("length").alias("path"), F.col("length").cast("string").alias("value")))
        return hit.select("doc_id", "line", F.explode(facts).alias("f")).select("doc_id", "line", "f.*")

    return answer


def phrase_question(segments: DataFrame, shortest: int = 4) -> Question:
    """How often a phrase occurs: segments (urn, doc_id, content) and documents that hold argument `phrase`, of `shortest` characters or more."""

    def answer(asked: DataFrame) -> DataFrame:
        phrases = asked.select(F.struct("doc_id", "line").alias("item_id"), F.element_at("arguments", "phrase").alias("text")).where(F.length("text") >= shortest)
        held = segments.select(F.struct("urn", F.col("doc_id").alias("of")).alias("doc_id"), F.col("content").alias("text"))
        found = find_passages(phrases, held, shortest).groupBy("item_id").agg(F.count_distinct("doc_id.urn").alias("segments"), F.count_distinct("doc_id.of").alias("documents"))
        counts = phrases.select("item_id").distinct().join(found, "item_id", "left")
        facts = F.array(*[F.struct(F.lit(f"total.{c}").alias("path"), F.coalesce(F.col(c), F.lit(0)).cast("string").alias("value")) for c in ("segments", "documents")])
        return counts.select("item_id.*", F.explode(facts).alias("f")).select("doc_id", "line", "f.*")

    return answer


def overall(statuses: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, status, replays, citations of reports: their records (doc_id, status) and their citations (doc_id, verdict). failed where any
    failed; no_checkable_evidence where there is none; incomplete where something was not verified; else verified."""
    n = lambda c: F.sum(c.cast("int"))
    a = statuses.select("doc_id", F.lit(1).alias("replay"), (F.col("status") == "failed").alias("bad"), (F.col("status") == "verified").alias("good"))
    b = citations.select("doc_id", F.lit(0).alias("replay"), (~F.col("verdict").isin("ok", "existence_only")).alias("bad"), (F.col("verdict") == "ok").alias("good"))
    rows = a.unionByName(b).groupBy("doc_id").agg(F.sum("replay").alias("replays"), F.sum(1 - F.col("replay")).alias("citations"), n(F.col("bad")).alias("bad"), n(F.col("good")).alias("good"), F.count("*").alias("n"))
    return rows.select("doc_id", F.when(F.col("bad") > 0, "failed").when(F.col("good") < F.col("n"), "incomplete").otherwise("verified").alias("status"), "replays", "citations")


def status_of(reports: DataFrame, statuses: DataFrame, citations: DataFrame) -> DataFrame:
    """overall for every report, those without any evidence among them."""
    rows = reports.select("doc_id").distinct().join(overall(statuses, citations), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("status", F.lit("no_checkable_evidence")).alias("status"), F.coalesce("replays", F.lit(0)).alias("replays"), F.coalesce("citations", F.lit(0)).alias("citations"))
