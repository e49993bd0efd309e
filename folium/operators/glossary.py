"""Glossaries: look-up of terms, agreement of two, addresses that entries cite, pairs for training, cases with expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normal(term):
    """A term without case and outer white space."""
    return F.lower(F.trim(term))


def lookup(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """term, rendering, status, alternatives of asked terms (term) in entries (term, rendering, rejected, verified): preferred where an entry is
    verified, unverified else, absent without one; rejected renderings are never offered."""
    held = entries.where(~F.coalesce("rejected", F.lit(False))).select(normal("term").alias("key"), "rendering", F.coalesce("verified", F.lit(False)).alias("verified"))
    counts = held.groupBy("key", "rendering").agg(F.max("verified").alias("verified"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("verified").desc(), F.col("n").desc(), "rendering"))
    best = counts.withColumn("at", place).withColumn("alternatives", F.count("*").over(W.partitionBy("key")) - 1).where("at = 1")
    rows = asked.select("term").distinct().withColumn("key", normal("term")).join(best, "key", "left")
    status = F.when(F.col("rendering").isNull(), "absent").when(F.col("verified"), "preferred").otherwise("unverified")
    return rows.select("term", "rendering", status.alias("status"), F.coalesce("alternatives", F.lit(0)).cast("long").alias("alternatives"))


def stats(entries: DataFrame) -> DataFrame:
    """entries, terms, rejected, unverified of a glossary."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")
    return entries.agg(F.count("*").alias("entries"), F.count_distinct(normal("term")).alias("terms"), n(F.col("rejected")).alias("rejected"), n(~F.coalesce("verified", F.lit(False))).alias("unverified"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """term, left, right, agreed of terms that both glossaries (term, value, at) have, each by its first entry."""
    first = lambda rows, name: rows.groupBy(normal("term").alias("term")).agg(F.min_by("value", "at").alias(name))
    both = first(left, "left").join(first(right, "right"), "term")
    return both.withColumn("agreed", normal("left") == normal("right"))


def cited_anchors(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """entry, citation, urn, problem of each citation ("work:page+register+line", a hyphen before the line counts from the foot) of entries
    (entry, citations) in an index of lines (urn, work, page, register, line): malformed, absent (work not held) or unresolved."""
    pattern = r"^([^:]+):(\d+)([abc])(-?)(\d+)$"
    part = lambda k: F.regexp_extract("citation", pattern, k)
    each = entries.select("entry", F.explode("citations").alias("citation"))
    each = each.select("entry", "citation", part(1).alias("work"), part(2).try_cast("long").alias("page"), part(3).alias("register"), (part(4) == "-").alias("foot"), part(5).try_cast("long").alias("asked"))
    spot = ["work", "page", "register"]
    last = lines.groupBy(*spot).agg(F.max("line").alias("last"))
    at = each.join(last, spot, "left").withColumn("line", F.when(F.col("foot"), F.col("last") - F.col("asked") + 1).otherwise(F.col("asked")))
    found = at.join(lines.select(*spot, "line", "urn"), [*spot, "line"], "left").join(lines.select("work", F.lit(True).alias("held")).distinct(), "work", "left")
    problem = F.when(F.col("work") == "", "malformed").when(F.col("held").isNull(), "absent").when(F.col("urn").isNull(), "unresolved")
    return found.select("entry", "citation", "urn", problem.alias("problem"))


def training_pairs(pairs: DataFrame, least: int = 60, low: float = 0.4, high: float = 4.0) -> DataFrame:
    """key, source, target, ratio of renderings long enough and of a plausible length (key, source, target)."""
    ratio = F.length("target") / F.length("source")
    return pairs.where((F.length("source") >= least) & (F.length("target") >= least)).select("key", "source", "target", F.round(ratio, 6).alias("ratio")).where(ratio.between(low, high))


def scored_cases(cases: DataFrame, found: DataFrame) -> DataFrame:
    """case_id, kind, outcome, rank of cases (case_id, kind, work, first, last, k) against ranked finds (case_id, rank, work, first, last):
    an expected range is hit by a find that overlaps it, an exact one by one that equals it, an absent one by none within k."""
    near = found.select("case_id", "rank", F.col("work").alias("f_work"), F.col("first").alias("f_first"), F.col("last").alias("f_last"))
    both = cases.join(near, "case_id", "left")
    inside = F.col("rank") <= F.col("k")
    touch = inside & (F.col("work") == F.col("f_work")) & (F.col("f_first") <= F.col("last")) & (F.col("f_last") >= F.col("first"))
    exact = touch & (F.col("f_first") == F.col("first")) & (F.col("f_last") == F.col("last"))
    hit = F.when(F.col("kind") == "exact", exact).otherwise(touch)
    rows = both.groupBy("case_id", "kind").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))
    outcome = F.when(F.col("kind") == "absent", F.when(F.col("rank").isNull(), "hit").otherwise("miss")).otherwise(F.when(F.col("rank").isNull(), "miss").otherwise("hit"))
    return rows.select("case_id", "kind", outcome.alias("outcome"), "rank")
