"""Segments, chunks, lexical search, surveys, passages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions import urn
from folium.functions.text import query_ngrams, query_words, variants, words
from folium.operators import finding, lexical, segments
from folium.plans.registry import query
from folium.sources.tables import ENTITIES, html_blocks, import_gate, latest_wins, table

PHRASE, GRAMS, WORDS, SPELLING = "and the", "thering", "on the thing and an ing", "cion"
ABSENT = "the zzz and"

#: Lines of documents with offsets, as SQL.
SEG = """seg as (
  select doc_id, lang, source, i - 1 as line_no, content,
    sum(case when content <> '' then 1 else 0 end) over (partition by doc_id order by i)::bigint - 1 as ordinal,
    coalesce(sum(length(content) + 1) over b, 0)::bigint as char_start, coalesce(sum(strlen(content) + 1) over b, 0)::bigint as byte_start
  from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
  window b as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
s as (select * from seg where content <> '')"""

#: Chunks of at most 300 characters over them.
ORACLE_CHUNKS = """r as (
  select doc_id, ordinal, content, length(content) as used, 0 as chunk_no from s where ordinal = 0
  union all
  select s.doc_id, s.ordinal, s.content, case when r.used + length(s.content) > 300 then length(s.content) else r.used + length(s.content) end,
    r.chunk_no + case when r.used + length(s.content) > 300 then 1 else 0 end
  from r join s on s.doc_id = r.doc_id and s.ordinal = r.ordinal + 1)"""


def _segments(spark, d, *keep):
    return segments.segment_lines(table(spark, d, "documents"), keep)


def _holding(spark, d, terms, *keep):
    """Segments of the documents that hold any of the terms, for searches over texts that aren't stored cut."""
    return segments.segment_lines(finding.holding(table(spark, d, "documents"), terms), keep)


@query(f"""with {SEG} select doc_id, ordinal, line_no::bigint as line_no, sha256(content) as content_sha256, char_start,
  char_start + length(content) as char_end, byte_start, byte_start + strlen(content) as byte_end from s""")
def segment_lines(spark, d):
    return _segments(spark, d).drop("content")


@query(f"""with {SEG} select count(*) as segments, count(*) filter (where ordinal = 0 and doc_id % 10 = 3 or ordinal = 1 and doc_id % 10 = 4 or ordinal = 2 and doc_id % 10 = 5) as faults, count(distinct doc_id) as documents from s""")
def segment_integrity(spark, d):
    """Faults planted in contents, offsets and hashes, counted with the clean segments of all documents."""
    docs = table(spark, d, "documents")
    at = lambda ordinal, rest: (F.col("ordinal") == ordinal) & (F.col("doc_id") % 10 == rest)
    s = segments.segment_lines(docs)
    s = s.withColumn("content", F.when(at(0, 3), F.concat("content", F.lit("x"))).otherwise(F.col("content"))).withColumn("char_start", F.when(at(1, 4), F.col("char_start") + 1).otherwise(F.col("char_start")))
    s = s.withColumn("content_sha256", F.when(at(2, 5), "-").otherwise(F.col("content_sha256")))
    faults = segments.segment_faults(s, docs).agg(F.count("*").alias("faults"))
    return s.agg(F.count("*").alias("segments"), F.count_distinct("doc_id").alias("documents")).crossJoin(faults).select("segments", "faults", "documents")


@query(f"""with {SEG} select source || ':' || doc_id || '@l' || min(line_no) || case when min(line_no) = max(line_no) then '' else '-l' || max(line_no) end as urn,
  source, doc_id::varchar as work, 'l' || min(line_no) as locator, 'l' || max(line_no) as locator_end from s group by doc_id, source""")
def urn_roundtrip(spark, d):
    ends = _segments(spark, d, "source").groupBy("doc_id", "source").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    line = lambda c: F.concat(F.lit("l"), F.col(c).cast("string"))
    built = ends.select(urn.span(F.col("source"), F.col("doc_id"), line("a"), line("b")).alias("urn"))
    locator = F.split(urn.part(F.col("urn"), 3), "-")
    return built.select("urn", urn.part(F.col("urn"), 1).alias("source"), urn.part(F.col("urn"), 2).alias("work"), F.get(locator, F.lit(0)).alias("locator"), F.element_at(locator, -1).alias("locator_end"))


@query("""with p as (select p_partkey, string_split(replace(p_name, ' ', '-') || '-' || p_size, '-') as x from part)
  select p_partkey, i::bigint as way, array_to_string(x[1:i], '-') as first, array_to_string(x[i + 1:], '-') as last from (select *, unnest(range(1, len(x))) as i from p)""")
def urn_splits(spark, d):
    locator = F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size").cast("string"))
    ways = table(spark, d, "part").select("p_partkey", F.posexplode(urn.splits(locator)).alias("way", "s"))
    return ways.select("p_partkey", (F.col("way") + 1).cast("long").alias("way"), "s.first", "s.last")


@query(f"""with recursive {SEG}, {ORACLE_CHUNKS}
select doc_id, chunk_no::bigint as chunk_no, min(ordinal) as first_ordinal, max(ordinal) as last_ordinal, count(*) as segment_count, sha256(string_agg(content, '' order by ordinal)) as content_sha256
from r group by doc_id, chunk_no""")
def chunk_greedy(spark, d):
    return segments.greedy_chunks(_segments(spark, d)).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "first_ordinal", "last_ordinal", "segment_count", "content_sha256")


def _hits_sql(terms: list[str], source: str = "s", limit: int = 20) -> str:
    lit = ["'" + t.replace("'", "''") + "'" for t in terms]
    matched = " + ".join(f"(contains(content, {t}))::bigint" for t in lit)
    total = " + ".join(f"((length(content) - length(replace(content, {t}, ''))) // length({t}))" for t in lit)
    return f"""select doc_id, ordinal, terms_matched, occurrences, row_number() over (order by terms_matched desc, occurrences desc, ordinal, doc_id) as rank
  from (select doc_id, ordinal, {matched} as terms_matched, {total} as occurrences from {source}) where terms_matched > 0 order by rank limit {limit}"""


@query(f"with {SEG} {_hits_sql([PHRASE])}")
def phrase_search(spark, d):
    return lexical.phrase_search(_holding(spark, d, [PHRASE]), PHRASE)


@query(f"with {SEG} {_hits_sql(query_ngrams(GRAMS))}")
def ngram_search(spark, d):
    return lexical.ngram_search(_holding(spark, d, query_ngrams(GRAMS)), GRAMS)


@query(f"with {SEG} {_hits_sql(query_words(WORDS))}")
def word_ngram_search(spark, d):
    return lexical.word_search(_holding(spark, d, query_words(WORDS)), WORDS)


@query(f"with {SEG} {_hits_sql(variants(SPELLING))}")
def variant_search(spark, d):
    return lexical.variant_search(_holding(spark, d, variants(SPELLING)), SPELLING)


@query(f"""with {SEG}, a as ({_hits_sql([PHRASE])}), b as ({_hits_sql(query_ngrams(ABSENT))})
  select 'found' as query, 'phrase' as mode, * from a union all select 'absent', 'ngram', * from b""")
def auto_search(spark, d):
    s = _holding(spark, d, [PHRASE, ABSENT, *query_ngrams(PHRASE), *query_ngrams(ABSENT)])
    found, absent = lexical.auto_search(s, PHRASE), lexical.auto_search(s, ABSENT)
    return found.withColumn("query", F.lit("found")).unionByName(absent.withColumn("query", F.lit("absent")))


@query(f"with {SEG}, t as (select * from s where lang in ('en', 'es') and (source is null or source not in ('src0', 'src8'))) {_hits_sql([PHRASE], 't')}")
def scoped_search(spark, d):
    return lexical.phrase_search(lexical.Scope(langs=("en", "es"), exclude_sources=("src0", "src8")).apply(_holding(spark, d, [PHRASE], "lang", "source")), PHRASE)


@query(f"""with {SEG}, h as (select * from s where contains(content, '{PHRASE}'))
select 'total' as axis, 'all' as value, count(*) as segments, count(distinct doc_id) as documents from h
union all select 'lang', lang, count(*), count(distinct doc_id) from h group by lang
union all select 'source', source, count(*), count(distinct doc_id) from h group by source
union all (select 'document', doc_id::varchar, count(*) as n, 1 from h group by doc_id order by n desc, doc_id limit 10)""")
def survey_corpus(spark, d):
    return lexical.survey(_holding(spark, d, [PHRASE], "lang", "source"), PHRASE)


@query("""select conv_id, turn, count(*) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding) as before,
  count(*) over (partition by conv_id order by turn rows between 1 following and 2 following) as after,
  sha256(array_to_string(list(text) over (partition by conv_id order by turn rows between 2 preceding and 2 following), chr(10))) as window_sha256 from conversations""")
def context_window(spark, d):
    return segments.context(table(spark, d, "conversations"), "conv_id", "turn", "text", 2).select("conv_id", "turn", "before", "after", F.sha2(F.col("window_text").cast("binary"), 256).alias("window_sha256"))


@query(f"""with {SEG}, r as (select doc_id, 1 as first, 3 as last from documents)
select doc_id, first::bigint as first, last::bigint as last, sha256(string_agg(content, chr(10) order by ordinal)) as text_sha256, min(char_start) as char_start, max(char_start + length(content)) as char_end
from s join r using (doc_id) where ordinal between first and last group by doc_id, first, last having min(ordinal) = first and max(ordinal) = last""")
def resolve_range(spark, d):
    docs = table(spark, d, "documents")
    ranges = docs.select("doc_id", F.lit(1).cast("long").alias("first"), F.lit(3).cast("long").alias("last"))
    return segments.resolve(segments.segment_lines(docs), ranges).drop("text")


@query("""select lang, source, lang || ' from ' || source as label, count(*) as documents, sum(n_chars)::bigint as chars from documents group by lang, source""")
def provenance_groups(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).withColumn("label", F.concat_ws(" from ", "lang", "source"))


@query("""select lang, count(*) as total, count(l.doc_id) as labelled, round(100.0 * count(l.doc_id) / count(*), 1) as percent from documents d left join (select distinct doc_id from labels) l using (doc_id) group by lang""")
def coverage_index(spark, d):
    marked = table(spark, d, "labels").select("doc_id").distinct().withColumn("marked", F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", "lang").join(marked, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("total"), F.count("marked").alias("labelled"), F.round(100.0 * F.count("marked") / F.count("*"), 1).alias("percent"))


DEFINING = {"en": "is the", "de": "ist die", "fr": "est la", "es": "es el"}


@query(f"""with {SEG}, f as (select * from (values {', '.join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(DEFINING.items()))}) as t(lang, formula, n))
select formula, doc_id, ordinal from (select f.formula, doc_id, ordinal, row_number() over (partition by doc_id, ordinal order by n) as k from s join f on s.lang = f.lang and contains(content, formula)) where k = 1""")
def definitions_find(spark, d):
    rows = [(k, v, i) for i, (k, v) in enumerate(DEFINING.items())]
    formulae = F.broadcast(spark.createDataFrame(rows, "lang string, formula string, n int"))  # a row per language
    hits = _segments(spark, d, "lang").join(formulae, "lang").where(F.contains("content", "formula"))
    first = F.row_number().over(W.partitionBy("doc_id", "ordinal").orderBy("n"))
    return hits.withColumn("k", first).where("k = 1").select("formula", "doc_id", "ordinal")


TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(f"""with d as (select doc_id, {TOKENS.format('text')} as w from documents),
q as (select unnest([['the', 'ing', 'thering'], ['idiot', 'zzzz']]) as terms, unnest([0, 1]) as query),
h as (select query, doc_id, len(list_intersect(terms, list_distinct(w))) as m, len(list_filter(w, lambda x: list_contains(terms, x))) as tf, len(terms) as n from d, q),
a as (select query, 'all' as mode, doc_id, tf from h where m = n), b as (select query, 'any', doc_id, tf from h where m > 0 and query not in (select query from a))
select query::bigint as query, mode, doc_id, tf::bigint as score from a union all select * from b""")
def fts_all_then_any(spark, d):
    rows = spark.createDataFrame([(0, ["the", "ing", "thering"]), (1, ["idiot", "zzzz"])], "query long, terms array<string>")
    asked = rows.select("query", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    wanted = F.array(*[F.lit(t) for t in ("the", "ing", "thering", "idiot", "zzzz")])  # only asked words are counted
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.filter(words(F.col("text")), lambda w: F.array_contains(wanted, w))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    hits = tokens.join(F.broadcast(asked), "term").groupBy("query", "n", "doc_id").agg(F.count("*").alias("m"), F.sum("tf").alias("score"))
    whole = hits.where("m = n").select("query", F.lit("all").alias("mode"), "doc_id", "score")
    some = hits.join(whole.select("query").distinct(), "query", "left_anti").select("query", F.lit("any").alias("mode"), "doc_id", "score")
    return whole.union(some)


DECODED = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _character in ENTITIES.items():
    DECODED = f"replace({DECODED}, '{_entity}', '{_character.replace(chr(39), chr(39) * 2)}')"


@query(r"""select page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) as title, len(regexp_extract_all(coalesce(html, ''), '(?i)<p[\s>]')) as n_paragraphs, len(regexp_extract_all(coalesce(html, ''), '(?i)<a\s')) as n_links,
  trim(regexp_replace({DECODED}, '\s+', ' ', 'g')) as body from pages""".replace("{DECODED}", DECODED))
def html_normalize(spark, d):
    return html_blocks(table(spark, d, "pages"))


@query("""select case when vec_id % 17 = 0 then 'malformed' when vec_id % 7 = 0 then 'unknown_id' when vec_id % 11 = 0 then 'wrong_dims' when vec_id % 13 = 0 then 'sha_mismatch' else 'taken' end as reject, count(*) as n from embeddings group by 1""")
def jsonl_import_gate(spark, d):
    e = table(spark, d, "embeddings")
    sha = F.sha2(F.col("vec_id").cast("string").cast("binary"), 256)
    known = e.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("id"), sha.alias("sha256"))
    rows = e.select(F.col("vec_id").alias("id"), F.when(F.expr("vec_id % 13 = 0"), F.lit("-")).otherwise(sha).alias("sha256"), F.when(F.expr("vec_id % 11 = 0"), F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"))
    # as JSON lines, some cut short, and back
    lines = rows.select("id", F.to_json(F.struct("id", "sha256", "embedding")).alias("line")).select(F.when(F.expr("id % 17 = 0"), F.substring("line", 1, 9)).otherwise(F.col("line")).alias("line"))
    read = lines.select(F.from_json("line", "id long, sha256 string, embedding array<float>", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    whole = import_gate(read.where("sha256 is not null"), known, 64)
    return whole.unionByName(read.where("sha256 is null").select(F.col("id"), F.lit("malformed").alias("reject"))).groupBy(F.coalesce("reject", F.lit("taken")).alias("reject")).agg(F.count("*").alias("n"))


@query("""select event_id, user_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""")
def latest_wins_upsert(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("at"))
    return latest_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "at").drop("at")
