"""Operator 4: mixing sources to target weights. DataFrame functions only.

A source's shuffled documents, end to end, form a line of words, cut into blocks
of equal size (about ``BLOCK_WORDS``). Slot i of the mix takes the point
``frac(i * golden ratio)``, which the cumulative block quotas map to a source;
slots are ranked within their source, and the slot of rank r takes block
``r mod (number of blocks)``, so a second pass over a source begins when all its
blocks are used. The mix is the join of slots with the documents' pieces.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and
share 150 % of all words; no target exceeds twice its source's words, the excess
going to the others by weight (water-filling, in closed form).

Nothing is ordered globally: ranks and positions are sums of per-chunk counts
plus a rank within a chunk, so the largest source is spread like the others.
Tables of one row a source are the only ones windowed whole.

Defined cases: a null text has size 0; a document without words takes 0; a null
source is a source of its own; rows that are equal are separate documents; a
source without words has target 0; an empty table gives an empty mix; extra
columns are left aside.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.llm.common import stored

BLOCK_WORDS = 64
#: Blocks that a small source is cut into at least (while it has as many words).
LEAST_BLOCKS = 32
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
#: Slots that one rank window holds.
CHUNK = 1 << 16
#: Documents of one bucket of the shuffle key at most, about; buckets are of leading hex digits, LEAST_DIGITS at least.
BUCKET_ROWS, LEAST_DIGITS = 4096, 3
WORD = r"[^\x20\x09-\x0D]+"

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
_HIGH = float(_GOLDEN * (1 << 20) % 1)


def golden_point(i: Column) -> Column:
    """frac(i * golden ratio), to about 1e-10 for any i up to 2**60."""
    low, high = i % (1 << 20), F.shiftright(i, 20)
    x = low * F.lit(float(_GOLDEN)) + (high % (1 << 20)) * F.lit(_HIGH) + F.shiftright(high, 20) * F.lit(float(_GOLDEN * (1 << 40) % 1))
    return x - F.floor(x)


def sized(documents: DataFrame) -> DataFrame:
    """row, doc_id, source, size, shuffle key of each document, stored because several steps read it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary"))).cast("binary"))
    rows = documents.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy()
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    ratio = F.col("cap") / F.col("weight")
    before = every.orderBy(ratio, "source").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("ratio", ratio)
    # sources below the first whose even share fits under its cap are full; the level there is everybody's
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _block_plan(targets: DataFrame, block_words: int) -> DataFrame:
    """Blocks, words a block, and how many blocks (with repeats) each source gives; stored: a row a source."""
    n = F.greatest(F.ceil(F.col("source_size") / block_words), F.least("source_size", F.lit(LEAST_BLOCKS)), F.lit(1))
    plan = targets.withColumn("blocks", n.cast("long")).withColumn("step", F.col("source_size") / F.col("blocks"))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("step")), F.col("blocks") * MOST_REPEATS)).otherwise(0).cast("long")
    plan = plan.withColumn("quota", quota)
    total = F.sum("quota").over(W.partitionBy())
    upto = F.sum("quota").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    return stored(plan.withColumn("high", F.when(total > 0, upto / total)).withColumn("low", F.when(total > 0, (upto - F.col("quota")) / total)), "mix-plan")


def slots(plan: DataFrame) -> DataFrame:
    """slot, source, rank, block: the low-discrepancy schedule, as many slots a source as its quota."""
    spark = plan.sparkSession
    total, least = plan.agg(F.sum("quota"), F.min(F.when(F.col("quota") > 0, F.col("quota")))).first()
    total = total or 0
    # a few more points than slots, so that every source reaches its quota: the counts of an interval
    # differ from its share by less than 2 ln(n) + 4 points
    extra = min(int((2 * len(bin(total)) + 8) * total / max(least or 1, 1)) + 64, 2 * total + 64) if total else 0
    cells = max(16, min(1 << 20, 4 * plan.count()))
    cell = lambda x: F.floor(x * cells)
    spans = plan.where("quota > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(cells - 1).cast("long")))))
    points = spark.range(0, total + extra).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", cell(F.col("point")))
    drawn = points.join(spans, "cell").where("low <= point and point < high").select("slot", "source", "blocks", "quota", F.shiftright("slot", CHUNK.bit_length() - 1).alias("chunk"))
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), before.alias("before"))
    local = drawn.withColumn("local", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = local.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.where("rank < quota").select("slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def pieces(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """row, doc_id, source, block, start (words of the document before it), length: documents cut at block ends."""
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(sizes.count(), 1) / BUCKET_ROWS, 16)))
    bucketed = sizes.where("size > 0").withColumn("bucket", F.substring("key", 1, digits))
    counts = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = bucketed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("begin", F.col("before") + F.col("local")).drop("s", "b")
    shape = plan.select(F.col("source").alias("s"), "blocks", "step")
    placed = placed.join(shape, F.col("source").eqNullSafe(F.col("s")))
    first = F.greatest(F.floor(F.col("begin") / F.col("step")) - 1, F.lit(0).cast("long"))
    last = F.least(F.floor((F.col("begin") + F.col("size") - 1) / F.col("step")) + 1, F.col("blocks") - 1)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    edge = lambda b: F.when(b == F.col("blocks"), F.floor(F.round(b * F.col("step")))).otherwise(F.floor(b * F.col("step")))
    low = F.greatest("begin", edge(F.col("block")))
    high = F.least(F.col("begin") + F.col("size"), edge(F.col("block") + 1))
    return cut.select("row", "doc_id", "source", "block", (low - F.col("begin")).alias("start"), (high - low).alias("length")).where("length > 0")


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schedule, sizes, targets). The schedule has a row per slot and document piece: slot, source, epoch, block, row, doc_id, start, length."""
    sizes = sized(documents)
    plan = _block_plan(source_targets(sizes), block_words)
    taken = slots(plan).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    parts = pieces(sizes, plan)
    schedule = taken.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("slot", "source", "epoch", "block", "row", "doc_id", "start", "length")
    return schedule, sizes, plan.select("source", "source_size", "target")


def taken_words(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row, doc_id, source, key, size, source_size, target, taken for every document."""
    schedule, sizes, targets = mix(documents, block_words)
    words = schedule.groupBy("row").agg(F.sum("length").alias("taken"))
    targets = targets.withColumnRenamed("source", "s")
    return sizes.join(words, "row", "left").join(targets, F.col("source").eqNullSafe(F.col("s"))).select("row", "doc_id", "source", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of documents, columns unchanged, each as often as the mix takes its words, rounded.

    As a source gives its first blocks and begins again after its last, every document is taken whole, as often as its
    neighbours or once more, but for the one at which the mix leaves off; so a source is off its target by a document at
    most. The schedule's order is that of `mix`; rows of a table have none."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).cast("binary"))
    # equal rows share what they take; the whole row is in one column, so that no name of documents can clash
    counts = taken_words(documents).groupBy("key", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = counts.select(F.col("key").alias("k"), F.col("source").alias("s"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("copies")).where("copies > 0")
    rows = documents.select(key.alias("key"), "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    joined = rows.join(copies, (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
