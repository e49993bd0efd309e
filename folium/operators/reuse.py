"""Verbatim text reuse between documents, quotations of given passages, and passage alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.text import ngrams
from folium.session import release, share_package, written

SEED, MOST, LEAST = 12, 200, 20


#: Characters of a text that are worked on at once, and rows that a batch holds.
STRETCH, BATCH = 1 << 20, 1 << 17
_MIX = np.random.default_rng(12).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _window_keys(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every n characters."""
    out = []
    for odd in _MIX:
        h = np.zeros(len(points) - n + 1, np.uint64)
        for j in range(n):
            h += points[j : j + len(h)] * odd[j]
            if j % 4 == 3:
                h ^= h >> np.uint64(29)
                h *= odd[-1 - j // 4]
        h ^= h >> np.uint64(32)
        out.append((h * odd[100]).view(np.int64))
    return out[0], out[1]


def seeds(texts: DataFrame, n: int = SEED) -> DataFrame:
    """doc_id, pos (from 0), a, b, prev, next: every run of n characters (at most 200) as two 64-bit hashes, and the characters around it (-1
    at the ends). Texts are read in stretches, so a long one costs no more memory than a short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        names = ["pos", "a", "b", "prev", "next"]

        def batch_of() -> pa.RecordBatch:
            ids = pa.concat_arrays([pa.repeat(x, len(c[0])) for x, c in held])
            return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in zip(*(c for _, c in held), strict=True))], ["doc_id", *names])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                around = np.concatenate([[-1], points.astype(np.int32), [-1]]).astype(np.int32)
                for s in range(0, max(0, len(points) - n + 1), STRETCH):
                    a, b = _window_keys(points[s : s + STRETCH + n - 1], n)
                    held.append((doc_id, (np.arange(s, s + len(a)), a, b, around[s : s + len(a)], around[s + n + 1 : s + n + 1 + len(a)])))
                    rows += len(a)
                    if rows >= BATCH:
                        yield batch_of()
                        held, rows = [], 0
        if held:
            yield batch_of()

    share_package(texts.sparkSession)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, pos long, a long, b long, prev int, next int")


def seed_counts(texts: DataFrame, n: int = SEED) -> DataFrame:
    """seed, n: occurrences in all texts, several in one text included; counted before anything is shuffled."""
    return texts.select(F.explode(ngrams(F.col("text"), n)).alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))


#: Windows that a task counts at once; groups, by one hash, in which seeds are counted by another; passes over the texts, each for a
#: share of the seeds, so that a pass moves that share alone.
COUNTED, GROUPS, PASSES = 1 << 21, 4096, 4


def seed_histogram(texts: DataFrame, n: int = SEED) -> DataFrame:
    """n, seeds: how many seeds (runs of n characters) occur n times in all texts, several in one text included.

    Seeds are known by 64 bits of one hash, and 14 of another that choose pass and group. A task counts its own first and sends a
    group's as two arrays; each pass is written before the next."""

    def cut(share: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0

            def counted() -> pa.RecordBatch:
                keys, group = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.argsort(group, kind="stable")
                at, sizes = np.unique(group[order], return_index=True), []
                for part in np.split(keys[order], at[1][1:]):
                    sizes.append([x.tobytes() for x in np.unique(part, return_counts=True)])
                return pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), *(pa.array(c, pa.binary()) for c in zip(*sizes, strict=True))], ["part", "seeds", "counts"])

            for batch in batches:
                for text in batch.column("text").to_pylist():
                    points = _points(text or "")
                    for s in range(0, max(0, len(points) - n + 1), STRETCH):
                        a, b = (x.view(np.uint64) for x in _window_keys(points[s : s + STRETCH + n - 1], n))
                        mine = (b >> np.uint64(32)) % np.uint64(PASSES) == share
                        held.append((a[mine], (b[mine] >> np.uint64(40)).astype(np.uint32).astype(np.uint16) % np.uint16(GROUPS)))
                        rows += len(held[-1][0])
                        if rows >= COUNTED:
                            yield counted()
                            held, rows = [], 0
            if rows:
                yield counted()

        return run

    def summed(group: pa.Table) -> pa.Table:
        seeds = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("seeds").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()])
        order = np.argsort(seeds)
        first = np.flatnonzero(np.append(True, np.diff(seeds[order]) != 0))
        times, number = np.unique(np.add.reduceat(counts[order], first), return_counts=True)
        return pa.table({"n": times, "seeds": number.astype(np.int64)})

    share_package(texts.sparkSession)
    out = []
    for share in range(PASSES):
        parts = texts.select("text").mapInArrow(cut(share), "part int, seeds binary, counts binary")
        out.append(written(parts.groupBy("part").applyInArrow(summed, "n long, seeds long").groupBy("n").agg(F.sum("seeds").alias("seeds")), "seeds"))
        del parts
        release(texts.sparkSession)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("n").agg(F.sum("seeds").alias("seeds"))


def _common(x: str, y: str) -> int:
    """Characters that two texts begin with in common: the first stretch that differs is halved."""
    lo, step = 0, 64
    while lo < min(len(x), len(y)) and x[lo : lo + step] == y[lo : lo + step]:
        lo, step = min(lo + step, len(x), len(y)), step * 2
    hi = min(lo + step, len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return lo


@F.pandas_udf(T.ArrayType(T.LongType()))
def _common_from(a: pd.Series, b: pd.Series, places: pd.Series) -> pd.Series:
    """For each place of a pair of texts, the characters in common from there on."""
    return pd.Series([[_common(x[p["a_start"] :], y[p["b_start"] :]) for p in at] for x, y, at in zip(a, b, places, strict=True)])


def reuse_pairs(texts: DataFrame, least: int = LEAST, most: int | None = MOST, n: int = SEED) -> DataFrame:
    """a_doc, a_start, b_doc, b_start, length of every maximal passage of at least `least` characters that two texts share.

    Only seeds that occur 2 to `most` times over all texts are paired (None: any number of times). A pair of equal seeds matters
    only where a match begins (the characters before differ) or ends (those after differ), so pairs grow with the number of matches,
    not with their length; seeds that have the same characters around them everywhere, or lie in one text, are dropped before anything
    is paired. A beginning whose end was not paired is measured on the texts themselves."""
    every, key = seeds(texts, n), ["a", "b"]
    edge = lambda c: (F.min(c) != F.max(c)) | (F.min(c) < 0)
    counts = every.groupBy(*key).agg(F.count("*").alias("n"), (edge("prev") | edge("next")).alias("edge"), (F.min("doc_id") != F.max("doc_id")).alias("shared"))
    usable = counts.where((F.col("n") >= 2) & F.col("edge") & F.col("shared"))
    hits = every.join((usable if most is None else usable.where(F.col("n") <= most)).select(*key), key)
    # rows of one key with the same characters around make no edge with each other, unless at a text's end: classes of at most `most`
    # rows are paired first; without a bound a class is a row
    place = F.struct("doc_id", "pos")
    kinds = hits.select(*key, "prev", "next", F.array(place).alias("places")) if most is None else hits.groupBy(*key, "prev", "next").agg(F.collect_list(place).alias("places"))
    side = lambda p: kinds.select(*key, *[F.col(c).alias(p + c) for c in ("prev", "next", "places")])
    begins = (F.col("a_prev") != F.col("b_prev")) | (F.col("a_prev") < 0) | (F.col("b_prev") < 0)
    ends = (F.col("a_next") != F.col("b_next")) | (F.col("a_next") < 0) | (F.col("b_next") < 0)
    classes = side("a_").join(side("b_"), key).where(begins | ends).select("a_places", "b_places", begins.alias("begins"), ends.alias("ends"))
    pairs = classes.select("begins", "ends", "b_places", F.explode("a_places").alias("a")).select("begins", "ends", "a", F.explode("b_places").alias("b")).where(F.col("a.doc_id") < F.col("b.doc_id"))
    edges = pairs.select(F.col("a.doc_id").alias("a_doc"), F.col("b.doc_id").alias("b_doc"), F.col("a.pos").alias("a_start"), (F.col("b.pos") - F.col("a.pos")).alias("diagonal"), "begins", "ends")
    w = W.partitionBy("a_doc", "b_doc", "diagonal").orderBy("a_start")
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    end = F.first(F.when(F.col("ends"), F.col("a_start")), ignorenulls=True).over(ahead)
    following = F.first(F.when(F.col("begins"), F.col("a_start")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    starts = edges.withColumn("end", end).withColumn("following", following).where("begins")
    closed = F.col("end").isNotNull() & (F.col("following").isNull() | (F.col("end") < F.col("following")))
    starts = starts.withColumn("b_start", F.col("a_start") + F.col("diagonal"))
    done = starts.where(closed).select("a_doc", "a_start", "b_doc", "b_start", (F.col("end") - F.col("a_start") + n).alias("length"))
    text = lambda p: texts.select(F.col("doc_id").alias(f"{p}_doc"), F.col("text").alias(f"{p}_text"))
    # texts are fetched once for all open beginnings of a pair
    asked = starts.where(~closed).groupBy("a_doc", "b_doc").agg(F.collect_list(F.struct("a_start", "b_start")).alias("places"))
    measured = asked.join(text("a"), "a_doc").join(text("b"), "b_doc").withColumn("lengths", _common_from("a_text", "b_text", "places"))
    open_ = measured.select("a_doc", "b_doc", F.explode(F.arrays_zip("places", "lengths")).alias("m")).select("a_doc", "m.places.a_start", "b_doc", "m.places.b_start", F.col("m.lengths").alias("length"))
    return done.union(open_).where(F.col("length") >= least)


#: A passage is looked up by its first n * GROWTH ** k characters, the most that it has.
GROWTH = 4
#: Bits of the filter for each of these beginnings, rounded up to a power of two, how many a beginning sets, and its most bits as a power.
FILTER_BITS, PROBES, MOST_FILTER = 32, 3, 27
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return h ^ (h >> np.uint64(31))


def _beginnings(points: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each size the hashes of every run of so many characters: differences of one running sum of characters times powers."""
    factors = np.full(len(points) + 1, _ODD)
    factors[0] = 1
    powers = np.cumprod(factors)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points + np.uint64(1)) * powers[:-1])])
    factors[1:] = _INVERSE
    back = np.cumprod(factors)
    for size in sizes:
        n = max(0, len(points) - size + 1)
        yield _mixed((sums[size : size + n] - sums[:n]) * back[:n] + np.uint64(size))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _beginning(n: int):
    """k and key of a passage of n characters or more: the hash of its first n * GROWTH ** k characters."""

    @F.pandas_udf("k int, key long")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            k = 0
            while n * GROWTH ** (k + 1) <= len(t):
                k += 1
            out.append((k, next(_beginnings(_points(t[: n * GROWTH**k]), [n * GROWTH**k])).view(np.int64)[0]))
        return pd.DataFrame(out, columns=["k", "key"])

    return of


def _shifts(power: int) -> list[int]:
    """Which bits of a key, from the top, are the places of its bits in a filter."""
    return [i * (64 - power) // (PROBES - 1) for i in range(PROBES)]


def _filter(wanted: DataFrame, keys: int) -> tuple[int, np.ndarray, list[int]]:
    """(bits as a power of two, words of 64 bits, each k there is) of the keys: PROBES bits of each are set."""
    power = min(MOST_FILTER, max(10, (FILTER_BITS * keys - 1).bit_length()))
    bits = F.explode(F.array(*[F.shiftrightunsigned(F.shiftleft("key", x), 64 - power) for x in _shifts(power)]))
    set_ = wanted.select("key", "k").distinct().select("k", bits.alias("bit"))
    at = F.expr("shiftleft(1L, cast(bit % 64 as int))"), F.expr("shiftleft(1L, k)")
    got = set_.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(at[0]).alias("bits"), F.bit_or(at[1]).alias("ks")).toArrow()  # at most a row a word
    words = np.zeros(1 << (power - 6), np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    ks = int(np.bitwise_or.reduce(got["ks"].to_numpy())) if got.num_rows else 0
    return power, words, [k for k in range(63) if ks >> k & 1]


def _may_begin(texts: DataFrame, n: int, power: int, words: np.ndarray, ks: list[int]) -> DataFrame:
    """doc_id, text, starts (of a start and its key) of the texts with any place where a passage may begin, by the filter."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(words)
    sizes = [n * GROWTH**k for k in ks]

    def may(keys: np.ndarray) -> np.ndarray:
        at = np.arange(len(keys))
        for x in _shifts(power):
            bit = (keys[at] << np.uint64(x)) >> np.uint64(64 - power)
            at = at[(held.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        return at

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts end to end, about a stretch at once; a longer one alone, in stretches that overlap
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [*(np.flatnonzero(np.diff(ends // STRETCH)) + 1).tolist(), batch.num_rows]
            for begin, end in zip([0, *cuts[:-1]], cuts, strict=True):
                part = batch.slice(begin, end - begin)
                points = _points("".join(t or "" for t in part.column("text").to_pylist()))
                base = int(ends[begin - 1]) if begin else 0
                stop = ends[begin:end] - base
                found: list[tuple[np.ndarray, ...]] = []
                for s in range(0, len(points), 4 * STRETCH):
                    for size, keys in zip(sizes, _beginnings(points[s : s + 4 * STRETCH + max(sizes) - 1], sizes), strict=True):
                        keys = keys[: 4 * STRETCH]
                        at = may(keys)
                        row = np.searchsorted(stop, at + s, side="right")
                        inside = at + s + size <= stop[row]
                        found.append((row[inside], at[inside] + s, keys[at[inside]].view(np.int64)))
                if not found:
                    continue
                row, at, keys = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                row, at, keys = row[order], at[order], keys[order]
                rows, first = np.unique(row, return_index=True)
                if not len(rows):
                    continue
                starts = pa.StructArray.from_arrays([pa.array(at - np.concatenate([[0], stop])[row]), pa.array(keys)], ["start", "key"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), starts)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).select(["doc_id", "text"]).columns, lists], ["doc_id", "text", "starts"])

    share_package(spark)
    fields = [T.StructField(c, texts.schema[c].dataType) for c in ("doc_id", "text")]
    return texts.select("doc_id", "text").mapInArrow(look, T.StructType([*fields, T.StructField("starts", T.ArrayType(T.StructType.fromDDL("start long, key long")))]))


def find_passages(passages: DataFrame, texts: DataFrame, n: int = SEED) -> DataFrame:
    """item_id, doc_id, start, length: every place where a passage of n characters or more stands in a text.

    A passage is known by a hash of its beginning, at least a quarter of it. A filter of these hashes, of bounded size, goes to where the
    texts are read, so only places that pass it meet the passages, and only texts with such a place are fetched, once, and compared whole
    (by md5). A crowded filter lets more places through and loses none."""
    spark = passages.sparkSession
    share_package(spark)
    wanted = passages.where(F.length("text") >= n).select("item_id", F.length("text").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"), _beginning(n)("text").alias("b")).select("item_id", "length", "digest", "b.*")
    wanted = written(wanted, "passages")  # read for the filter, and again to be met
    power, words, ks = _filter(wanted, wanted.agg(F.approx_count_distinct("key")).first()[0])
    if not ks:
        return spark.createDataFrame([], T.StructType([passages.schema["item_id"], texts.schema["doc_id"], *T.StructType.fromDDL("start long, length long")]))
    near = written(_may_begin(texts, n, power, words, ks), "near")
    places = near.select("doc_id", F.explode("starts").alias("s")).select("doc_id", "s.*").join(wanted, "key").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "length", "digest")).alias("places"))
    same = lambda p: F.md5(F.col("text").substr((p["start"] + 1).cast("int"), p["length"]).cast("binary")) == p["digest"]
    hit = near.select("doc_id", "text").join(places, "doc_id").select("doc_id", F.explode(F.filter("places", same)).alias("p"))
    return hit.select("p.item_id", "doc_id", F.col("p.start").cast("long").alias("start"), F.col("p.length").cast("long").alias("length"))


def overlapping(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """spans with the segments they overlap; a touch at an end is no overlap."""
    return spans.join(segments, "doc_id").where((F.col("char_start") < F.col("start") + F.col("length")) & (F.col("char_end") > F.col("start")))


def graph_stats(matches: DataFrame, work: str) -> DataFrame:
    """matches, works, longest, median length."""
    return matches.agg(F.count("*").alias("matches"), F.count_distinct(work).alias("works"), F.max("length").alias("longest"), F.expr("percentile_cont(0.5) within group (order by length)").alias("median"))


#: Fixed value: what ends a syllable of Tibetan.
TSHEG = "་"


def _units(text: Column, syllables: bool) -> Column:
    """The characters (or syllables, each with what ends it) of a text that aren't white space: unit, from, to in the text as it is."""
    chars = F.split(text, "")
    if not syllables:
        each = F.transform(chars, lambda c, i: F.struct(c.alias("unit"), i.alias("from"), (i + 1).alias("to")))
        return F.filter(each, lambda u: ~u["unit"].rlike(r"^\s*$"))
    ends = F.array_distinct(F.concat(F.filter(F.transform(chars, lambda c, i: F.when(c == TSHEG, i + 1)), lambda e: e.isNotNull()), F.array(F.length(text))))
    span = lambda a, b: F.struct(F.regexp_replace(F.array_join(F.slice(chars, a + 1, b - a), ""), r"^\s+|\s+$", "").alias("unit"), a.alias("from"), b.alias("to"))
    return F.filter(F.transform(ends, lambda e, i: span(F.when(i > 0, F.get(ends, i - 1)).otherwise(0), e)), lambda u: u["unit"] != "")


def _windows(rows: DataFrame, key: list[str], text: str, n: int, name: str, syllables: bool) -> DataFrame:
    """key, gram, name (the window's place among the units), name_from, name_to: windows of n units that aren't white space, with
    the place of each in the text as it is."""
    units = rows.where(F.col(text).isNotNull()).select(*key, _units(F.col(text), syllables).alias("u"))
    at = F.sequence(F.lit(1), F.size("u") - n + 1)
    windows = F.transform(F.when(F.size("u") >= n, at).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i - 1).cast("long").alias(name), F.array_join(F.transform(F.slice("u", i, n), lambda x: x["unit"]), "").alias("gram"), F.get("u", i - 1)["from"].cast("long").alias(f"{name}_from"), F.get("u", i + n - 2)["to"].cast("long").alias(f"{name}_to")))
    return units.select(*key, F.explode(windows).alias("w")).select(*key, "w.*")


def lemma_spans(pairs: DataFrame, n: int | None = None, syllables: bool = False) -> DataFrame:
    """pair, c_start, c_end, r_start, r_end of passages of a commentary that quote its root (columns pair, commentary, root), as
    places in both texts as they are: white space is not matched on, and what lies within a passage belongs to it.

    Windows of n units (8 characters, or 6 syllables) that are unique in the root are looked up in the commentary; hits that
    advance together are one passage."""
    n = n or (6 if syllables else 8)
    root = _windows(pairs, ["pair"], "root", n, "r", syllables)
    unique = root.groupBy("pair", "gram").agg(F.min(F.struct("r", "r_from", "r_to")).alias("at"), F.count("*").alias("k")).where("k = 1").select("pair", "gram", "at.*")
    hits = _windows(pairs, ["pair"], "commentary", n, "c", syllables).join(unique, ["pair", "gram"])
    w = W.partitionBy("pair").orderBy("c")
    new = F.coalesce((F.col("c") != F.lag("c").over(w) + 1) | (F.col("r") != F.lag("r").over(w) + 1), F.lit(True))
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("pair", "run").agg(F.min("c_from").alias("c_start"), F.max("c_to").alias("c_end"), F.min("r_from").alias("r_start"), F.max("r_to").alias("r_end")).drop("run")


def union_length(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered: length of the union of the intervals [start, end) of each key."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(w), F.col(start))
    return spans.withColumn("_add", F.greatest(F.col(end) - F.greatest(F.col(start), reach), F.lit(0))).groupBy(key).agg(F.sum("_add").cast("long").alias("covered"))


#: Spans per 10,000 characters of commentary that an alignment needs, by the unit and the commentary's role, and the
#: percentage that must move forward where the unit is the syllable.
DENSITY_FLOOR, SUBCOMMENTARY_FLOOR, SYLLABLE_FLOOR, SYLLABLE_FORWARD = 30.0, 14.0, 20.0, 80.0


def align_metrics(pairs: DataFrame, spans: DataFrame, syllables: bool = False) -> DataFrame:
    """pair, spans, density (per 10,000 characters of commentary), root_pct (of the root's characters, an overlap once), forward_pct (of
    consecutive spans; 0 where there is one span), aligned. A column `role` of the pairs lowers the floor of subcommentaries."""
    w = W.partitionBy("pair").orderBy("c_start", "r_start")
    ahead = spans.withColumn("ahead", (F.col("r_start") >= F.lag("r_start").over(w)).cast("int")).groupBy("pair").agg(F.count("*").alias("spans"), F.avg("ahead").alias("forward"))
    cover = union_length(spans, "pair", "r_start", "r_end")
    role = F.col("role") if "role" in pairs.columns else F.lit(None).cast("string")
    rows = pairs.select("pair", role.alias("role"), F.greatest(F.length("commentary"), F.lit(1)).alias("c_len"), F.greatest(F.length("root"), F.lit(1)).alias("r_len")).join(ahead, "pair").join(cover, "pair")
    density, forward = 10000.0 * F.col("spans") / F.col("c_len"), F.round(100.0 * F.coalesce("forward", F.lit(0.0)), 1)
    floor = F.lit(SYLLABLE_FLOOR) if syllables else F.when(F.col("role") == "subcommentary", SUBCOMMENTARY_FLOOR).otherwise(DENSITY_FLOOR)
    aligned = (density >= floor) & (forward >= (SYLLABLE_FORWARD if syllables else 0.0))
    return rows.select("pair", "spans", F.round(density, 1).alias("density"), F.round(100.0 * F.col("covered") / F.col("r_len"), 1).alias("root_pct"), forward.alias("forward_pct"), aligned.alias("aligned"))


def ranges_text(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, ranges: a key's distinct integers as runs, such as 1-3, 7."""
    w = W.partitionBy(key).orderBy(value)
    runs = values.select(key, value).distinct().withColumn("_run", F.col(value) - F.row_number().over(w)).groupBy(key, "_run").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    text: Column = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))
