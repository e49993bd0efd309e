"""Rows that carry vectors: which there must be, which are stale or pending, which a search may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import character

KINDS = ("source", "translation")


def source_rows(chunks: DataFrame, languages: dict[str, str], default: str) -> DataFrame:
    """chunk, kind, lang, translator, sha256 of one source vector a chunk (chunk, source, content); the language follows the source."""
    lang = F.lit(default)
    for source, code in languages.items():
        lang = F.when(F.col("source") == source, code).otherwise(lang)
    return chunks.select("chunk", F.lit("source").alias("kind"), lang.alias("lang"), F.lit(None).cast("string").alias("translator"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("sha256"))


def parallel_rows(chunks: DataFrame, lines: DataFrame, parallels: DataFrame, renderings: DataFrame) -> DataFrame:
    """chunk, translator, n_texts, text: the different renderings of the lines that run parallel to a chunk's, joined in order.

    chunks (chunk, work, first, last), lines (work, ordinal, line), parallels (a, b: lines), renderings (line, translator, text)."""
    held = chunks.select("chunk", "work", F.explode(F.sequence("first", "last")).alias("ordinal")).join(lines, ["work", "ordinal"])
    other = held.select("chunk", F.col("line").alias("a")).distinct().join(parallels.select("a", F.col("b").alias("line")).distinct(), "a").select("chunk", "line")
    texts = other.join(renderings, "line").select("chunk", "translator", "text").distinct()
    return texts.groupBy("chunk", "translator").agg(F.count("*").alias("n_texts"), F.array_join(F.sort_array(F.collect_list("text")), " / ").alias("text"))


def state(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk, kind, lang, translator, state of vectors (…, sha256) against what there must be: current, stale (another content),
    missing, or orphan. Two missing translators are the same."""
    keys = ["chunk", "kind", "lang", "translator"]
    a, b = (x.select(*keys, "sha256").alias(n) for x, n in ((held, "a"), (wanted, "b")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same, "full_outer")
    verdict = F.when(F.col("a.sha256").isNull(), "missing").when(F.col("b.sha256").isNull(), "orphan").when(F.col("a.sha256") == F.col("b.sha256"), "current").otherwise("stale")
    return both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], verdict.alias("state"))


def pending(rows: DataFrame, model: str, window: int) -> DataFrame:
    """Rows without an embedding, or whose embedding is another model's or another window's."""
    return rows.where(F.col("embedding").isNull() | ~F.col("model").eqNullSafe(F.lit(model)) | ~F.col("window").eqNullSafe(F.lit(window)))


def rebuild_loss(held: DataFrame, rebuilt: DataFrame, key: str = "chunk") -> DataFrame:
    """lost, allowed: embedded rows whose key and content (sha256) a rebuild does not have; a rebuild that loses any is refused."""
    lost = held.where("embedding is not null").join(rebuilt.select(key, "sha256").distinct(), [key, "sha256"], "left_anti")
    return lost.agg(F.count("*").alias("lost")).withColumn("allowed", F.col("lost") == 0)


def scoped(rows: DataFrame, kinds: tuple[str, ...] = KINDS, langs: tuple[str, ...] = (), translators: tuple[str, ...] = (), allowed: DataFrame | None = None) -> DataFrame:
    """Rows (chunk, kind, lang, translator) that a vector search may use. Translators bind translations only; `allowed` (chunk) binds
    them to stated chunks, by a semi join."""
    rows = rows.where(F.col("kind").isin(*kinds))
    if langs:
        rows = rows.where(F.col("lang").isin(*langs))
    if translators:
        rows = rows.where((F.col("kind") != "translation") | F.col("translator").isin(*translators))
    if allowed is not None:
        free = rows.where(F.col("kind") != "translation")
        rows = free.unionByName(rows.where(F.col("kind") == "translation").join(allowed.select("chunk").distinct(), "chunk", "left_semi").select(*free.columns))
    return rows


def licensed(rows: DataFrame, licences: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Rows whose source has one of the licence classes (source, license_class); a source without one is left out."""
    return rows.join(licences.where(F.col("license_class").isin(*classes)).select("source").distinct(), "source", "left_semi")


def reviewed(rows: DataFrame, states: tuple[str, ...], floor: str, attested_only: bool = False) -> DataFrame:
    """Rows (state, attested) at or above a state in the order of `states`; a state that isn't listed is below all."""
    if floor not in states:
        raise ValueError(f"floor must be one of {states}")
    rank = F.array_position(F.array(*[F.lit(s) for s in states]), F.coalesce("state", F.lit("")))
    rows = rows.where(rank >= states.index(floor) + 1)
    return rows.where("attested") if attested_only else rows


def covered_chunks(chunks: DataFrame, points: DataFrame, ranges: DataFrame) -> DataFrame:
    """translator, chunks: how many chunks (chunk, work, first, last) a translator has a rendering in, by points (work, ordinal,
    translator) or ranges (work, first, last, translator); a chunk counts once."""
    held = chunks.select("chunk", "work", F.explode(F.sequence("first", "last")).alias("ordinal"))
    spread = ranges.select("work", "translator", F.explode(F.sequence("first", "last")).alias("ordinal"))
    every = points.select("work", "translator", "ordinal").unionByName(spread).distinct()
    return held.join(every, ["work", "ordinal"]).groupBy("translator").agg(F.count_distinct("chunk").alias("chunks"))


def blinded_sheet(rows: DataFrame, item: str, hand: str, salt: str, repeat_percent: int = 10) -> DataFrame:
    """item, place, letter, hand, repeat: every item's hands under letters in a salted order, items shuffled, and about
    `repeat_percent` of the items a second time under another order, to measure the judge. Letters go on by code point from A, past
    the surrogates, which are no characters."""
    key = lambda *x: F.md5(F.concat_ws("|", F.lit(salt), *x).cast("binary"))
    again = rows.where(F.conv(F.substring(key(F.lit("again"), F.col(item).cast("string")), 1, 6), 16, 10).cast("long") % 100 < repeat_percent)
    both = rows.select(item, hand, F.lit(0).alias("repeat")).unionByName(again.select(item, hand, F.lit(1).alias("repeat")))
    nth = F.row_number().over(W.partitionBy(item, "repeat").orderBy(key(F.col(item).cast("string"), F.col(hand), F.col("repeat").cast("string")), hand))
    letter = character(F.when(nth < 0xD800 - 64, nth + 64).otherwise(nth + 64 + 0x800))
    return both.select(item, "repeat", key(F.lit("place"), F.col(item).cast("string"), F.col("repeat").cast("string")).alias("place"), letter.alias("letter"), hand)
