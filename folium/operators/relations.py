"""Relations derived from titles, shared text and parallels, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import ngrams


def title_match(sources: DataFrame, targets: DataFrame, key: int = 3) -> DataFrame:
    """source, target, candidates, confidence: the longest target title inside each source title (not equal to it).

    A containment join made an equality join: a title that contains another has its first `key` characters somewhere.
    Several longest ones make the match ambiguous."""
    windows = sources.select("source", F.explode(F.array_distinct(ngrams(F.col("source"), key))).alias("gram"))
    heads = targets.where(F.length("target") >= key).select("target", F.substring("target", 1, key).alias("gram"))
    hits = windows.join(heads, "gram").where(F.contains("source", "target") & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    place = F.rank().over(W.partitionBy("source").orderBy(F.length("target").desc()))
    best = hits.withColumn("place", place).where("place = 1")
    many = best.groupBy("source").agg(F.count("*").alias("candidates"), F.min("target").alias("target"))
    return many.select("source", "target", "candidates", F.when(F.col("candidates") == 1, "certain").otherwise("ambiguous").alias("confidence"))


def dominant_family(passages: DataFrame, strong: int) -> DataFrame:
    """work, family, passages, runner_up, families, tied, band, members of passages (work, member, family, passage).

    Per work the family with most distinct passages, the runner-up's number and whether the first place is shared."""
    per = passages.groupBy("work", "family").agg(F.count_distinct("passage").alias("passages"), F.array_join(F.sort_array(F.collect_set("member")), ",").alias("members"))
    w = W.partitionBy("work")
    order = w.orderBy(F.col("passages").desc(), "family")
    placed = per.withColumn("place", F.row_number().over(order)).withColumn("level", F.rank().over(w.orderBy(F.col("passages").desc()))).withColumn("runner_up", F.lead("passages").over(order)).withColumn("families", F.count("*").over(w))
    tied = F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w) > 1
    first = placed.withColumn("tied", tied).where("place = 1")
    return first.select("work", "family", "passages", F.coalesce("runner_up", F.lit(0)).alias("runner_up"), "families", "tied", F.when(F.col("tied"), "tied").when(F.col("passages") >= strong, "strong").otherwise("weak").alias("band"), "members")


def parallels_to_relations(parallels: DataFrame, least: int = 3, sure: int = 10) -> DataFrame:
    """source, target, n, confidence, both ways, of unordered pairs with enough full parallels (a, b, partial)."""
    pair = parallels.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "partial")
    counts = pair.groupBy("lo", "hi").agg(F.sum(F.when(~F.col("partial"), 1).otherwise(0)).alias("n")).where(F.col("n") >= least)
    rows = counts.withColumn("confidence", F.when(F.col("n") >= sure, "probable").otherwise("possible"))
    return rows.select(F.col("lo").alias("source"), F.col("hi").alias("target"), "n", "confidence").union(rows.select("hi", "lo", "n", "confidence"))


def walk_up(starts: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """start, hop, node, stopped: the chain from each start along its nodes' first upward edge to a node not seen before (edges:
    node, up).

    A path has at most `most` + 1 nodes, so of a node's edges the first `most` + 2 are enough; a chain has one row a hop.
    stopped: end (no edge), cycle (edges to nodes seen before only) or limit."""
    place = F.row_number().over(W.partitionBy("node").orderBy("up"))
    first = edges.where("up is not null").select("node", "up").distinct().withColumn("_at", place).where(F.col("_at") <= most + 2)
    ups = first.groupBy("node").agg(F.sort_array(F.collect_list("up")).alias("ups"))
    level = starts.select(F.col("start"), F.lit(0).alias("hop"), F.col("start").alias("node"), F.array("start").alias("path"))
    done = None
    for hop in range(most + 1):
        ahead = level.join(ups, "node", "left").withColumn("up", F.get(F.filter("ups", lambda u: ~F.array_contains("path", u)), F.lit(0)))
        ahead = ahead.withColumn("stopped", F.when(F.col("ups").isNull(), "end").when(F.col("up").isNull(), "cycle").when(F.lit(hop == most), "limit"))
        rows = ahead.select("start", "hop", "node", "stopped")
        done = rows if done is None else done.union(rows)
        level = ahead.where("stopped is null").select("start", (F.col("hop") + 1).alias("hop"), F.col("up").alias("node"), F.array_append("path", F.col("up")).alias("path"))
    return done


def longest_name(texts: DataFrame, names: DataFrame, key: int = 3) -> DataFrame:
    """text_id, name_id of the one longest name in each text (text_id, text; name_id, name); refused where several tie."""
    windows = texts.select("text_id", "text", F.explode(F.array_distinct(ngrams(F.col("text"), key))).alias("gram"))
    hits = windows.join(names.select("name_id", "name", F.substring("name", 1, key).alias("gram")), "gram").where(F.contains("text", "name"))
    place = F.rank().over(W.partitionBy("text_id").orderBy(F.length("name").desc()))
    best = hits.withColumn("place", place).where("place = 1").groupBy("text_id").agg(F.count_distinct("name_id").alias("n"), F.min("name_id").alias("name_id"))
    return best.where("n = 1").select("text_id", "name_id")


def range_lookup(rows: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """Each row with the label of the range lo..hi that holds its value; ranges is a small table, a row per range."""
    return rows.join(F.broadcast(ranges), F.col(value).between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, take: str) -> DataFrame:
    """left with the value of `take` of the last right row of its key at or before its time; one sort a key, no range join."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_take", F.lit(None).cast(right.schema[take].dataType)).unionByName(right.select(key, at, F.col(take).alias("_take"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(f"last_{take}", F.last("_take", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_take")


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """node, hop: everything within `hops` edges (a, b, either way) of the seeds (node), each at its least distance.

    A hop is one join of the newest nodes and one anti-join with those known."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    known = seeds.select("node", F.lit(0).alias("hop")).distinct()
    newest = known
    for hop in range(1, hops + 1):
        reached = newest.join(both, newest["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        newest = reached.join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        known = known.union(newest)
    return known


def longest_prefix(paths: DataFrame, prefixes: DataFrame, separator: str = "/") -> DataFrame:
    """path and the label of the longest prefix (prefix, label) that it continues at a separator; null without one.

    A path's own prefixes are few, so they are listed and joined by equality."""
    steps = F.split("path", separator)
    own = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), separator))
    each = paths.select("path").distinct().select("path", F.explode(own).alias("prefix")).join(prefixes, "prefix")
    best = each.groupBy("path").agg(F.max_by("label", F.length("prefix")).alias("label"))
    return paths.join(best, "path", "left")
