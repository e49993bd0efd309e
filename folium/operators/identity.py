"""Content identity, sampling, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_digest(*columns: str) -> Column:
    """sha256 of the columns as text; a null differs from an empty value."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]).cast("binary"), 256)


#: Row digests that one bucket of a table's digest joins at most, about.
BUCKET_ROWS = 1 << 16


def set_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """n, digest of a table: digests of rows, hashed in order within buckets of their leading digits, then bucket by bucket up a
    tree of 256 branches.

    The digits are 2 at least and grow with the table, so a bucket joins about BUCKET_ROWS digests whatever the size; the order
    is by digest, so the result doesn't depend on partitions."""
    hashed = rows.select(row_digest(key, *columns).alias("h"))
    digits = 2
    while 16**digits * BUCKET_ROWS < hashed.count():
        digits += 2
    join = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["h"]), "").cast("binary"), 256)
    level = hashed.groupBy(F.substring("h", 1, digits).alias("bucket")).agg(F.count("*").alias("n"), join(F.struct("h")).alias("h"))
    while digits > 2:
        digits -= 2
        level = level.groupBy(F.substring("bucket", 1, digits).alias("bucket_")).agg(F.sum("n").alias("n"), join(F.struct("bucket", "h")).alias("h")).withColumnRenamed("bucket_", "bucket")
    return level.agg(F.sum("n").alias("n"), join(F.struct("bucket", "h")).alias("digest"))


def stamped(rows: DataFrame, **identity: str) -> DataFrame:
    """rows under the identities of what they come from, such as bake_id and release_id, as their last columns."""
    return rows.select("*", *[F.lit(v).alias(k) for k, v in identity.items()])


def drift(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (added, removed, changed) between two states of a table."""
    a = before.select(key, row_digest(key, *columns).alias("old"))
    b = after.select(key, row_digest(key, *columns).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def seeded_sample(rows: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """n rows, the same for the same salt on any engine: the first in the order of md5(salt + key)."""
    return rows.withColumn("_order", F.md5(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"))).orderBy("_order", key).limit(n).drop("_order")


def scorecard(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes (hit, rank, state) by group: cases, counted, hits, rate, mean_rank; stale and failed cases don't count."""
    counted = F.col("state") == "ok"
    hit = counted & F.col("hit")
    rows = outcomes.groupBy(*by).agg(F.count("*").alias("cases"), F.sum(counted.cast("int")).cast("long").alias("counted"), F.sum(hit.cast("int")).cast("long").alias("hits"), F.round(F.avg(F.when(hit, F.col("rank"))), 2).alias("mean_rank"))
    return rows.withColumn("rate", F.when(F.col("counted") > 0, F.round(100.0 * F.col("hits") / F.col("counted"), 1)))


def gate(current: DataFrame, baseline: DataFrame, by: list[str], tolerate: int = 1) -> DataFrame:
    """by, now, was, verdict between two scorecards: a group may lose `tolerate` hits."""
    both = current.select(*by, F.col("hits").alias("now")).join(baseline.select(*by, F.col("hits").alias("was")), by, "full_outer")
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") < F.col("was") - tolerate, "regressed").when(F.col("now") > F.col("was"), "improved").otherwise("held")
    return both.select(*by, "now", "was", verdict.alias("verdict"))


def agreement(rows: DataFrame, floor: float, least: int) -> DataFrame:
    """check, agreed, total, rate, status of rows (check, agrees): no verdict on fewer than `least`."""
    sums = rows.groupBy("check").agg(F.sum(F.col("agrees").cast("int")).cast("long").alias("agreed"), F.count("*").alias("total")).withColumn("rate", F.round(F.col("agreed") / F.col("total"), 6))
    return sums.withColumn("status", F.when(F.col("total") < least, "too_few").when(F.col("rate") >= floor, "pass").otherwise("fail"))


def hit_at_k(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """case_id, hit, rank: the best rank at which any expected key was found among the first k."""
    hits = found.where(F.col("rank") <= k).join(expected, ["case_id", "key"]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    return expected.select("case_id").distinct().join(hits, "case_id", "left").select("case_id", F.col("rank").isNotNull().alias("hit"), "rank")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in an order."""
    return rows.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
