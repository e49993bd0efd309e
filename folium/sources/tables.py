"""Readers that turn files and raw columns into the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entities of markup and their characters; an ampersand last, so that none is decoded twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "\u2014", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """Text with its entities as characters."""
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, title, n_paragraphs, n_links, body: the text of a page without its markup, its entities decoded."""
    count = lambda pattern: F.regexp_count(F.coalesce("html", F.lit("")), F.lit(pattern)).cast("long")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return pages.select(
        "page_id", F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), count(r"(?i)<p[\s>]").alias("n_paragraphs"), count(r"(?i)<a\s").alias("n_links"),
        F.trim(F.regexp_replace(decoded(bare), r"\s+", " ")).alias("body"),
    )


def segment_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """work, locator, text from objects {"work:1.2.3": text}, in the natural order of the numbers."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("id", "text"))
    located = pairs.select(F.split_part("id", F.lit(":"), F.lit(1)).alias("work"), F.split_part("id", F.lit(":"), F.lit(2)).alias("locator"), "text")
    order = F.transform(F.split("locator", r"\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("long"))
    return located.withColumn("ordinal", F.row_number().over(W.partitionBy("work").orderBy(order, "locator")) - 1)


def anchored_text(lines: DataFrame) -> DataFrame:
    """volume, line_no, work, anchor, text of plain text with [anchor] prefixes and {work} marks; a work's mark holds until the next."""
    mark = F.regexp_extract("value", r"\{(D\d+[a-z]?)\}", 1)
    held = F.last(F.when(mark != "", mark), ignorenulls=True).over(W.partitionBy("volume").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    clean = F.trim(F.regexp_replace(F.regexp_replace("value", r"\{D\d+[a-z]?\}", ""), r"^\[[^\]]*\]", ""))
    out = lines.select("volume", "line_no", held.alias("work"), F.regexp_extract("value", r"^\[([^\]]+)\]", 1).alias("anchor"), clean.alias("text"))
    nth = F.row_number().over(W.partitionBy("volume", "anchor").orderBy("line_no")) - 1
    return out.withColumn("anchor", F.when((F.col("anchor") != "") & (nth > 0), F.concat("anchor", F.lit("+"), nth.cast("string"))).otherwise(F.col("anchor")))


def glossary_markdown(lines: DataFrame) -> DataFrame:
    """category, term, rendering, rejected from pipe tables under ## headings."""
    section = F.regexp_extract("value", r"^##\s+(.+?)\s*$", 1)
    held = lines.withColumn("category", F.last(F.when(section != "", section), ignorenulls=True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    cells = F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\s*\|\s*")
    rows = held.where(F.col("value").rlike(r"^\s*\|.*\|\s*$") & ~F.col("value").rlike(r"^\s*\|[\s:\-|]+$")).select("file", "line_no", "category", F.trim(F.get(cells, F.lit(0))).alias("term"), F.get(cells, F.lit(1)).alias("cell"))
    return rows.select("file", "line_no", "category", "term", F.trim(F.regexp_replace("cell", r"\*\*not\*\*\s+\"[^\"]*\",?", "")).alias("rendering"), F.regexp_extract_all("cell", F.lit(r"\*\*not\*\*\s+\"([^\"]*)\""), F.lit(1)).alias("rejected"))


def volumes_joined(lines: DataFrame) -> DataFrame:
    """work, volume, ordinal, n_juan of lines (work, canon, volume, line_no, juan) of works in several volumes: numbered over the volumes, with
    the count of different juan; a work whose volumes name several canons is refused."""
    per = lines.groupBy("work").agg(F.count_distinct("canon").alias("canons"), F.count_distinct("juan").alias("n_juan")).where("canons = 1").drop("canons")
    place = F.row_number().over(W.partitionBy("work").orderBy("volume", "line_no"))
    return lines.join(per, "work").select("work", "volume", (place - 1).cast("long").alias("ordinal"), "n_juan")


def file_census(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lock_mismatches(found: DataFrame, locked: DataFrame) -> DataFrame:
    """path, problem (missing, unexpected, changed) between files and a lock of path, sha256."""
    both = found.alias("f").join(locked.alias("l"), "path", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("l.sha256").isNull(), "unexpected").when(F.col("f.sha256") != F.col("l.sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def import_gate(rows: DataFrame, known: DataFrame, dims: int) -> DataFrame:
    """id, reject of imported vectors (id, sha256, embedding) against known (id, sha256); reject is null for those taken."""
    both = rows.alias("r").join(known.select(F.col("id"), F.col("sha256").alias("known_sha")), "id", "left")
    reject = F.when(F.col("known_sha").isNull(), "unknown_id").when(F.coalesce(F.size("embedding"), F.lit(-1)) != dims, "wrong_dims").when(F.col("r.sha256") != F.col("known_sha"), "sha_mismatch")
    return both.select("id", reject.alias("reject"))


def latest_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of the rows of a key the one of greatest `order`, incoming before stored on a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc()))
    return both.withColumn("_at", place).where("_at = 1").drop("_at", "_new")
