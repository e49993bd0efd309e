"""Operator 7: document fingerprints by Merkle trees. DataFrame functions only.

Tree: a paragraph (line) is cut into pieces (up to ``PIECE`` code points that end
at a sentence's end), which are the leaves; a paragraph hashes its leaves' hashes,
a section is a run of paragraphs that ends after one whose hash ends in 0 or 1 (so
an inserted paragraph moves no later boundary) and hashes its paragraphs; the root
hashes the sections. Equal roots mean equal texts; sections, then paragraphs,
whose hashes differ locate edits.

The fingerprint is the root, a colon, and the paragraphs' leaves (``DIGEST``
digits each, a comma after a paragraph). Likeness descends both trees: sections
that both have count whole and are left, then the paragraphs that the other
sections share, then the leaves that the other paragraphs share; it is twice the
leaves so shared over the leaves of both. As equal branches hold equal leaves,
that is what all leaves without the tree would give.

Each document is compared with an edited version of itself: its last third is
replaced by the beginning of the next document in descending order of doc_id.
Neighbours are found within ranges of doc_id (a window per range of about
``RANGE_ROWS`` rows) and, at their edges, by a join of one row a range. Missing
ids, and ids of a share of 1 in ``BANDS`` or more, have ranges of their own,
which are ranges of the texts' hashes.

Defined cases: a null text is an empty one; an empty text has a root and no
leaves; two texts without leaves have likeness 1, one of them 0; null ids come
last in the descending order, rows of equal ids are ordered by the text's md5; a
lone document is its own successor; an empty table gives no rows; extra columns
are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE = 128
RANGE_ROWS = 1000
#: Quantiles of doc_id within which ranges are of equal width.
BANDS = 32
DIGEST = 12


def paragraphs(text: Column) -> Column:
    """Each paragraph as its leaves' digests, a colon, its hash."""

    def paragraph(line: Column) -> Column:
        piece = F.regexp_extract_all(line, F.lit(r"([^.!?]{1,%d}[.!?]*|[.!?]{1,%d})" % (PIECE, PIECE)), F.lit(1))
        whole = F.transform(piece, lambda p: F.md5(p.cast("binary")))
        # 32 digits a leaf, of which the digest keeps the first DIGEST
        joined = F.array_join(whole, "")
        return F.concat(F.regexp_replace(joined, r"(.{%d}).{%d}" % (DIGEST, 32 - DIGEST), "$1"), F.lit(":"), F.substring(F.md5(joined.cast("binary")), 1, 2 * DIGEST))

    return F.transform(F.split(text, "\n"), paragraph)


def sections(paragraphs_: Column) -> Column:
    """Sections of paragraphs: these with spaces between, a bar, the section's hash."""
    return F.transform(F.split(F.array_join(paragraphs_, " "), "(?<=[01]) "), lambda s: F.concat(s, F.lit("|"), F.sha2(s.cast("binary"), 256)))


def root(sections_: Column) -> Column:
    """Hash of the sections' hashes."""
    return F.sha2(F.array_join(F.transform(sections_, lambda s: F.substring_index(s, "|", -1)), " ").cast("binary"), 256)


def _numbered(a: Column) -> Column:
    """A sorted array whose repeated elements carry their occurrence number, so that sets of the results compare multisets.

    The number is found by halving steps back through equal elements. `a` must be a plain column."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])

    def number(x: Column, i: Column) -> Column:
        back = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(a, i - n - s) == x, n + s).otherwise(n))
        return F.when((i > 0) & (F.get(a, i - 1) == x), F.concat_ws(".", x, back.cast("string"))).otherwise(x)

    return F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(F.transform(a, number))


def _with(rows: DataFrame, columns: list[str], f) -> DataFrame:
    """rows with each of the columns replaced by f of it, in one step."""
    return rows.select(*[c for c in rows.columns if c not in columns], *[f(F.col(c)).alias(c) for c in columns])


def _descend(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """rows with each pair's two columns of branches reduced to those that the other column doesn't have."""
    every = [c for pair in pairs for c in pair]
    rows = _with(_with(rows, every, F.array_sort), every, _numbered)
    return rows.select(*[c for c in rows.columns if c not in every], *[F.array_except(x, y).alias(x) for a, b in pairs for x, y in ((a, b), (b, a))])


def _below(rows: DataFrame, columns: list[str], end: str, f) -> DataFrame:
    """rows with each column's branches replaced by those below them."""
    return _with(rows, columns, lambda c: F.flatten(F.transform(c, lambda x: f(F.substring_index(x, end, 1)))))


def likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows, where each pair's two columns of sections give way to the pair's likeness."""
    every = [c for pair in pairs.values() for c in pair]
    count = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda n, s: n + F.length(F.regexp_replace(F.substring_index(s, "|", 1), ":[0-9a-f]+ ?", "")) / DIGEST)
    rows = rows.select("*", *[(count(F.col(a)) + count(F.col(b))).alias(f"all_{k}") for k, (a, b) in pairs.items()])
    rows = _below(_descend(rows, list(pairs.values())), every, "|", lambda s: F.split(s, " "))
    rows = _below(_descend(rows, list(pairs.values())), every, ":", lambda p: F.regexp_extract_all(p, F.lit("(.{%d})" % DIGEST), F.lit(1)))
    rows = _descend(rows, list(pairs.values()))
    near = lambda k, a, b: F.when(F.col(f"all_{k}") == 0, F.lit(1.0)).otherwise((F.col(f"all_{k}") - F.size(a) - F.size(b)) / F.col(f"all_{k}"))
    return rows.select(*[c for c in rows.columns if c not in every and not c.startswith("all_")], *[near(k, a, b).alias(k) for k, (a, b) in pairs.items()])


def tree(documents: DataFrame) -> DataFrame:
    """doc_id, section, paragraph, section_hash, paragraph_hash: the branches of each document's tree."""
    per = documents.select("doc_id", F.posexplode(sections(paragraphs(F.coalesce(F.col("text"), F.lit(""))))).alias("section", "branch"))
    below = per.select("doc_id", "section", F.substring_index("branch", "|", -1).alias("section_hash"), F.posexplode(F.split(F.substring_index("branch", "|", 1), " ")).alias("paragraph", "p"))
    return below.select("doc_id", "section", "section_hash", "paragraph", F.substring_index("p", ":", -1).alias("paragraph_hash"))


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, section, paragraph, change ('removed' or 'added') of the paragraphs under differing branches.

    Sections whose hash both versions of a document have are not looked into."""
    a, b = tree(before), tree(after)
    keys = ["doc_id", "section_hash"]
    differing_a, differing_b = a.join(b.select(keys).distinct(), keys, "left_anti"), b.join(a.select(keys).distinct(), keys, "left_anti")
    cut = ["doc_id", "paragraph_hash"]
    removed = differing_a.join(differing_b.select(cut).distinct(), cut, "left_anti").withColumn("change", F.lit("removed"))
    added = differing_b.join(differing_a.select(cut).distinct(), cut, "left_anti").withColumn("change", F.lit("added"))
    return removed.unionByName(added).select("doc_id", "section", "paragraph", "change")


def _ranges(rows: DataFrame) -> Column:
    """A column that numbers ranges in the order of the rows (doc_id descending, nulls last, then hash), each of about RANGE_ROWS rows."""
    q = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / BANDS for k in range(BANDS + 1)], 2000)).first()[0] or []))
    id_, known = F.col("doc_id"), F.array(*[F.lit(x).cast("long") for x in q]) if q else F.array().cast("array<long>")
    # kinds of rows in descending order of doc_id: an id that is a quantile, the ids between two, no id
    upto = F.size(F.filter(known, lambda x: x <= id_))
    alone = F.array_contains(known, id_)
    kind = F.when(id_.isNull(), 2 * len(q) + 2).otherwise(2 * (len(q) - upto) + 1 + alone.cast("int"))
    counts = dict(rows.groupBy(kind.alias("kind")).count().collect())  # at most 2 * BANDS + 4 rows
    n = F.get(F.array(*[F.lit(max(1, -(-counts.get(k, 0) // RANGE_ROWS))) for k in range(2 * len(q) + 3)]), kind)
    low, high = F.get(known, upto - 1), F.get(known, upto)
    between = F.coalesce((high - id_).cast("double") / (high - low), F.lit(0.0))
    share = F.when(id_.isNull() | alone, F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / (1 << 32)).otherwise(between)
    return kind.cast("long") * (1 << 40) + F.least(F.floor(share * n), n.cast("long") - 1)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text and the text of the next document in descending order of doc_id (the first after the last)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.md5(F.col("text").cast("binary")))
    rows = rows.withColumn("part", _ranges(rows))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc()]
    w = W.partitionBy("part").orderBy(*order)
    numbered = rows.withColumn("next", F.lead("text").over(w)).withColumn("at", F.row_number().over(w)).withColumn("is_last", F.col("at") == F.count("*").over(W.partitionBy("part")))
    # the first row of each range, given to the range before it
    parts = rows.groupBy("part").agg(F.lit(1).alias("one")).select("part", F.coalesce(F.lead("part").over(W.partitionBy().orderBy("part")), F.min("part").over(W.partitionBy())).alias("after"))
    heads = numbered.where(F.col("at") == 1).select(F.col("part").alias("after"), F.col("text").alias("head"))
    heads = parts.join(heads, "after").select("part", "head")
    return numbered.join(heads, "part", "left").select("doc_id", "text", F.when(F.col("is_last"), F.col("head")).otherwise(F.col("next")).alias("next"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = with_next(documents).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - third), F.col("next").substr(F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("changed"), paragraphs(F.col("next")).alias("following"))
    digests = lambda c: F.array_join(F.transform(c, lambda p: F.substring_index(p, ":", 1)), ",")
    rows = rows.select("doc_id", "n_chars", "edited_sha256", digests(F.col("own")).alias("own_leaves"), digests(F.col("changed")).alias("changed_leaves"), *[sections(F.col(c)).alias(c) for c in ("own", "changed", "following")])
    name = lambda c: F.concat(root(F.col(c)), F.lit(":"), F.col(f"{c}_leaves"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", name("own").alias("fingerprint"), name("changed").alias("edited_fingerprint"), "own", "changed", F.col("own").alias("own_too"), "following")
    return likeness(rows, {"near_edited": ("own", "changed"), "near_next": ("own_too", "following")})
