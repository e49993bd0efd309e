"""Relations between works, the alignments that stand on them, glosses, versions, lineages, readiness of what is derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.operators.relations import as_of
from folium.operators.reuse import align_metrics, lemma_spans

UPWARD = ("comments_on", "subcommentary_of")


def asserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Relations (source, target, ref, relation, method, at) after an upsert by source, target, ref, relation and method; of one key
    the latest counts. A relation names a target or a reference that isn't resolved; one without either, or to itself, is refused."""
    valid = incoming.where((F.col("target").isNotNull() | F.col("ref").isNotNull()) & ~F.coalesce(F.col("target") == F.col("source"), F.lit(False)))
    both = stored.withColumn("_new", F.lit(0)).unionByName(valid.withColumn("_new", F.lit(1)))
    place = F.row_number().over(W.partitionBy("source", "target", "ref", "relation", "method").orderBy(F.col("at").desc(), F.col("_new").desc()))
    return both.withColumn("_at", place).where("_at = 1").drop("_at", "_new")


def neighbours(relations: DataFrame) -> DataFrame:
    """work, commentaries, explains, parallels, explanatory: what is known of each work from its relations."""
    n = lambda c: F.sum(c.cast("int")).cast("long")
    up = F.col("relation").isin(*UPWARD)
    out = relations.select(F.col("source").alias("work"), F.lit(False).alias("below"), up.alias("explains"), (~up).alias("parallel"))
    into = relations.where("target is not null").select(F.col("target").alias("work"), up.alias("below"), F.lit(False).alias("explains"), (~up).alias("parallel"))
    rows = out.unionByName(into).groupBy("work").agg(n(F.col("below")).alias("commentaries"), n(F.col("explains")).alias("explains"), n(F.col("parallel")).alias("parallels"))
    return rows.withColumn("explanatory", F.col("explains") > 0)


def pairs_to_align(relations: DataFrame, works: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """source, target: commentaries and what they explain where both are held (work, source_id) in allowed sources."""
    held = works.where(F.col("source_id").isin(*sources)).select("work").distinct()
    pairs = relations.where(F.col("relation").isin(*UPWARD) & F.col("target").isNotNull()).select("source", "target").distinct()
    return pairs.join(held.withColumnRenamed("work", "source"), "source", "left_semi").join(held.withColumnRenamed("work", "target"), "target", "left_semi").select("source", "target")


def _segments_over(spans: DataFrame, segments: DataFrame, doc: str, start: str, end: str, first: str, last: str) -> DataFrame:
    """spans with the ordinals of the first and the last segment (doc_id, ordinal, char_start, char_end) that each reaches into;
    null where it reaches into none. Two look-ups by place (the last that begins before a span's end, and, backwards, the last that
    ends after its start), and no join of every span with every segment of its text."""
    side = lambda at, name: segments.select(F.col("doc_id").alias("_doc"), at.cast("long").alias("at"), F.struct("ordinal", "char_start").alias(name))
    rows = as_of(spans.withColumn("_doc", F.col(doc)).withColumn("at", F.col(end).cast("long") - 1), side(F.col("char_start"), "begun"), "_doc", "at", "begun")
    rows = as_of(rows.withColumn("at", -F.col(start).cast("long") - 1), side(-F.col("char_end"), "open"), "_doc", "at", "open")
    held = F.col("last_open.char_start") < F.col(end)
    return rows.withColumn(first, F.when(held, F.col("last_open.ordinal"))).withColumn(last, F.when(held, F.col("last_begun.ordinal"))).drop("_doc", "at", "last_begun", "last_open")


def alignments(pairs: DataFrame, segments: DataFrame, syllables: bool = False) -> DataFrame:
    """pair, c_doc, r_doc, c_start, c_end, c_first, c_last, r_start, r_end, r_first, r_last, length, lemma_sha256, density, forward_pct,
    method, confidence: the passages of aligned pairs (pair, c_doc, r_doc, commentary, root), each with the segments (doc_id, ordinal,
    char_start, char_end) that it reaches into at both ends. A pair that isn't aligned gives no row, and neither does one of
    which any passage reaches into no segment: it is written whole or not at all."""
    spans = lemma_spans(pairs, syllables=syllables)
    found = align_metrics(pairs, spans, syllables).where("aligned").select("pair", "density", "forward_pct")
    rows = spans.join(found, "pair").join(pairs.select("pair", "c_doc", "r_doc", "root"), "pair")
    lemma = F.substring("root", F.col("r_start").cast("int") + 1, (F.col("r_end") - F.col("r_start")).cast("int"))
    rows = rows.withColumn("lemma_sha256", F.sha2(lemma.cast("binary"), 256)).drop("root").withColumn("length", F.col("r_end") - F.col("r_start"))
    rows = _segments_over(_segments_over(rows, segments, "c_doc", "c_start", "c_end", "c_first", "c_last"), segments, "r_doc", "r_start", "r_end", "r_first", "r_last")
    lost = rows.where("c_first is null or r_first is null").select("pair").distinct()
    kept = rows.join(lost, "pair", "left_anti").withColumn("method", F.lit("lemma_match")).withColumn("confidence", F.lit("probable"))
    return kept.select("pair", "c_doc", "r_doc", "c_start", "c_end", "c_first", "c_last", "r_start", "r_end", "r_first", "r_last", "length", "lemma_sha256", "density", "forward_pct", "method", "confidence")


def glosses_on(alignments: DataFrame, lines: DataFrame) -> DataFrame:
    """work, ordinal, gloss, length, place, to_review: glosses (work, first, last, gloss, length, reviewed) on each asked line (work,
    ordinal), the longest first."""
    at = alignments.select("work", "gloss", "length", "reviewed", F.explode(F.sequence("first", "last")).alias("ordinal"))
    place = F.row_number().over(W.partitionBy("work", "ordinal").orderBy(F.col("length").desc(), "gloss"))
    return at.join(lines.select("work", "ordinal").distinct(), ["work", "ordinal"]).select("work", "ordinal", "gloss", "length", place.cast("long").alias("place"), (~F.col("reviewed")).alias("to_review"))


def alignment_outline(alignments: DataFrame, divisions: DataFrame) -> DataFrame:
    """work, division, glosses, lines, commentaries: how much of each division (work, division, lo, hi) has glosses (work, first, last,
    gloss, commentary)."""
    at = alignments.select("work", "gloss", "commentary", F.explode(F.sequence("first", "last")).alias("ordinal"))
    held = divisions.select("work", "division", F.explode(F.sequence("lo", "hi")).alias("ordinal"))
    hits = held.join(at, ["work", "ordinal"])
    return hits.groupBy("work", "division").agg(F.count_distinct("gloss").alias("glosses"), F.count_distinct("ordinal").alias("lines"), F.count_distinct("commentary").alias("commentaries"))


def precision_by_band(found: DataFrame, known: DataFrame) -> DataFrame:
    """band, judged, right, precision of relations (source, target, band) whose source a known table (source, target) has."""
    truth = known.select("source", F.col("target").alias("true")).distinct()
    judged = found.join(truth.select("source").distinct(), "source", "left_semi")
    hit = judged.join(truth, (judged["source"] == truth["source"]) & (judged["target"] == truth["true"]), "left_semi").select("source", "target", F.lit(1).alias("hit")).distinct()
    rows = judged.join(hit, ["source", "target"], "left").groupBy("band").agg(F.count("*").alias("judged"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("right"))
    return rows.withColumn("precision", F.round(F.col("right") / F.col("judged"), 6))


def versions(work: DataFrame, renderings: DataFrame, parallels: DataFrame, alternates: DataFrame) -> DataFrame:
    """work, kind, other, note: renderings (work, translator), parallel works (a, b) and alternate editions (work, edition) of the asked
    works, each under its own kind."""
    asked = work.select("work").distinct()
    kinds = [
        renderings.join(asked, "work", "left_semi").groupBy("work", F.col("translator").alias("other")).agg(F.concat(F.count("*").cast("string"), F.lit(" passages")).alias("note")).withColumn("kind", F.lit("rendering")),
        parallels.select(F.col("a").alias("work"), F.col("b").alias("other")).union(parallels.select("b", "a")).distinct().join(asked, "work", "left_semi").withColumn("note", F.lit("another text")).withColumn("kind", F.lit("parallel")),
        alternates.select("work", F.col("edition").alias("other")).distinct().join(asked, "work", "left_semi").withColumn("note", F.lit("the same text")).withColumn("kind", F.lit("alternate")),
    ]
    return kinds[0].select("work", "kind", "other", "note").unionByName(kinds[1].select("work", "kind", "other", "note")).unionByName(kinds[2].select("work", "kind", "other", "note"))


def readiness(wanted: DataFrame, receipts: DataFrame) -> DataFrame:
    """name, ready, problem: whether each derivation's (name, version, input_digest, output_digest, n) receipt is complete and still fits."""
    r = receipts.select("name", *[F.col(c).alias(f"r_{c}") for c in ("complete", "version", "input_digest", "output_digest", "n")], F.lit(True).alias("has"))
    both = wanted.join(r, "name", "left")
    problem = F.when(F.col("has").isNull(), "no_receipt").when(~F.coalesce("r_complete", F.lit(False)), "incomplete")
    for c in ("version", "input_digest", "output_digest", "n"):
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"r_{c}")), c)
    return both.select("name", problem.isNull().alias("ready"), problem.alias("problem"))


def lineage(starts: DataFrame, teachers: DataFrame, most: int = 10) -> DataFrame:
    """start, hop, person, branches, stopped: the chain of teachers (person, teacher) from each start (person); where there are several
    the least goes on and `branches` says how many; stopped: end, cycle or limit."""
    only = teachers.where("teacher is not null").groupBy("person").agg(F.min("teacher").alias("teacher"), F.count_distinct("teacher").alias("branches"))
    level = starts.select(F.col("person").alias("start"), F.lit(0).alias("hop"), "person", F.array("person").alias("path"))
    done = None
    for hop in range(most + 1):
        ahead = level.join(only, "person", "left").withColumn("stopped", F.when(F.col("teacher").isNull(), "end").when(F.array_contains("path", F.col("teacher")), "cycle").when(F.lit(hop == most), "limit"))
        rows = ahead.select("start", F.col("hop").cast("long").alias("hop"), "person", F.coalesce("branches", F.lit(0)).alias("branches"), "stopped")
        done = rows if done is None else done.unionByName(rows)
        level = ahead.where("stopped is null").select("start", (F.col("hop") + 1).alias("hop"), F.col("teacher").alias("person"), F.array_append("path", F.col("teacher")).alias("path"))
    return done
