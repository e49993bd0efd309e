"""Provenance scope, phrase / n-gram / word search, scoring and surveys over segments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import occurrences, query_ngrams, query_words, variants

MOST_HITS = 200


@dataclass(frozen=True)
class Scope:
    """One set of provenance predicates for every kind of search. A null never equals a wanted value; excluding keeps nulls."""

    langs: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    exclude_sources: tuple[str, ...] = ()
    doc_ids: tuple[int, ...] = ()
    #: Any other columns and the values wanted of each, such as origin, role, division, work or witness.
    columns: tuple[tuple[str, tuple], ...] = ()

    def apply(self, rows: DataFrame) -> DataFrame:
        for column, wanted in (("lang", self.langs), ("source", self.sources), ("doc_id", self.doc_ids), *self.columns):
            if wanted:
                rows = rows.where(F.col(column).isin(*wanted))
        if self.exclude_sources:
            rows = rows.where(F.col("source").isNull() | ~F.col("source").isin(*self.exclude_sources))
        return rows


def _scored(segments: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Segments with any of the terms: doc_id, ordinal, terms_matched, occurrences, rank.

    Ranked by terms matched, then occurrences, then place in the text; of the whole match set, the first `limit`."""
    if not terms:
        raise ValueError("the query has no terms")
    if not 0 < limit <= MOST_HITS:
        raise ValueError(f"limit must be 1 to {MOST_HITS}")
    found = [F.col("content").contains(t) for t in terms]
    rows = segments.where(reduce(lambda a, b: a | b, found))
    matched = reduce(lambda a, b: a + b, [f.cast("long") for f in found])
    total = reduce(lambda a, b: a + b, [occurrences(F.col("content"), t) for t in terms])
    rows = rows.select("doc_id", "ordinal", matched.alias("terms_matched"), total.alias("occurrences"))
    return ranked(rows, [F.col("terms_matched").desc(), F.col("occurrences").desc(), F.col("ordinal"), F.col("doc_id")], limit)


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in an order, numbered from 1: a top-k per partition, merged. Only these are numbered in one task, so there is
    always a limit."""
    from pyspark.sql import Window as W

    if limit < 1:
        raise ValueError("a ranking has a limit")
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.partitionBy().orderBy(*order)).cast("long"))


def phrase_search(segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return _scored(segments, [query.strip()] if query.strip() else [], limit)


def ngram_search(segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return _scored(segments, query_ngrams(query), limit)


def word_search(segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return _scored(segments, query_words(query), limit)


def variant_search(segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return _scored(segments, variants(query), limit)


def auto_search(segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """mode and the phrase's hits; where it has none, the n-grams'. The second arm is skipped by a one-row test, in one plan."""
    phrase = phrase_search(segments, query, limit).withColumn("mode", F.lit("phrase"))
    grams = ngram_search(segments, query, limit).withColumn("mode", F.lit("ngram"))
    any_phrase = segments.where(F.col("content").contains(query.strip())).agg((F.count("*") > 0).alias("hit"))
    return phrase.unionByName(grams.join(F.broadcast(any_phrase), ~F.col("hit")).drop("hit"))


def survey(segments: DataFrame, query: str, top: int = 10) -> DataFrame:
    """axis, value, segments, documents: totals of every segment that holds the phrase, by language, source and document.

    One scan with grouping sets; `top` bounds the rows of the document axis."""
    hits = segments.where(F.col("content").contains(query))
    sets = hits.groupingSets([[], ["lang"], ["source"], ["doc_id"]], "lang", "source", "doc_id").agg(F.count("*").alias("segments"), F.count_distinct("doc_id").alias("documents"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "lang").when(F.col("g") == 5, "source").otherwise("document")
    value = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, F.col("lang")).when(F.col("g") == 5, F.col("source")).otherwise(F.col("doc_id").cast("string"))
    rows = sets.select(axis.alias("axis"), value.alias("value"), "segments", F.when(F.col("g") == 6, 1).otherwise(F.col("documents")).cast("long").alias("documents"), "doc_id")
    works = rows.where("axis = 'document'").orderBy(F.col("segments").desc(), F.col("doc_id")).limit(top)
    return rows.where("axis <> 'document'").union(works).drop("doc_id")


def composed(rows: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Rows (date_start, date_end, date_basis) whose dating reaches into the years asked for; a date without a basis never does."""
    if after is not None:
        rows = rows.where(F.col("date_basis").isNotNull() & (F.coalesce("date_end", "date_start") >= after))
    if before is not None:
        rows = rows.where(F.col("date_basis").isNotNull() & (F.coalesce("date_start", "date_end") <= before))
    return rows


def ablated(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """About `percent` of the rows, by a bucket of md5(key): the same rows on any engine, and nested as percent grows."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 100
    return rows.where(bucket < percent)
