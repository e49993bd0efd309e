"""Further queries: address resolution, renderings on chunks, prefixes, expansion, bounds and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import citing, lexical, relations, segments
from folium.plans.corpus import ORACLE_CHUNKS, PHRASE, SEG, _hits_sql
from folium.plans.registry import query
from folium.sources.tables import table


def _lines(spark, d, *keep):
    return segments.segment_lines(table(spark, d, "documents"), keep)


@query(f"""with recursive {SEG}, {ORACLE_CHUNKS}, h as ({_hits_sql([PHRASE], 's', 100)})
select h.doc_id, chunk_no::bigint as chunk_no, case when chunk_no is null then h.ordinal end as ordinal, min(rank) as rank from h left join r on h.doc_id = r.doc_id and h.ordinal = r.ordinal and chunk_no <> 1 group by 1, 2, 3""")
def hits_to_chunks(spark, d):
    s = _lines(spark, d)
    # the second chunk of a text is left out, so that some hits have none
    chunks = segments.greedy_chunks(s).where("chunk_no <> 1")
    return segments.map_to_chunks(lexical.phrase_search(s, PHRASE, 100), chunks).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "ordinal", "rank")


@query(f"""with {SEG}, l as (select doc_id || '/' || ordinal as urn, doc_id % 50 as volume, line_no // 4 as page, case line_no % 2 when 0 then 'a' else 'b' end as register, line_no % 4 as line from s),
a as (select doc_id as id, doc_id % 50 as volume, 0 as page, 'a' as register, doc_id % 3 as line, doc_id % 2 = 0 as from_foot from documents),
m as (select volume, page, register, max(line) as last from l group by 1, 2, 3),
w as (select id, volume, page, register, case when from_foot then last - line + 1 else line end as line from a left join m using (volume, page, register)),
h as (select id, count(urn) as n, min(urn) as urn from w left join l using (volume, page, register, line) group by id)
select id, case when n = 1 then urn end as urn, case when n = 0 then 'not_found' when n > 1 then 'ambiguous' end as problem from h""")
def address_to_urn(spark, d):
    at = F.col("line_no")
    lines = _lines(spark, d).select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("urn"), (F.col("doc_id") % 50).alias("volume"), F.expr("line_no div 4").alias("page"), F.when(at % 2 == 0, "a").otherwise("b").alias("register"), (at % 4).alias("line"))
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("volume"), F.lit(0).cast("long").alias("page"), F.lit("a").alias("register"), (F.col("doc_id") % 3).alias("line"), (F.col("doc_id") % 2 == 0).alias("from_foot"))
    return citing.address_to_urn(asked, lines)


@query(f"""with {SEG} select doc_id as work, ordinal as n, char_start as start, 'exact' as how from s""")
def cursor_alignment(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    passages = segments.segment_lines(docs).select(F.col("doc_id").cast("string").alias("work"), F.col("ordinal").alias("n"), F.col("content").alias("text"))
    got = citing.cursor_alignment(passages, docs.select(F.col("doc_id").cast("string").alias("work"), "text"))
    return got.select(F.col("work").cast("long").alias("work"), "n", "start", "how")


@query(f"""with recursive {SEG}, {ORACLE_CHUNKS}, c as (select doc_id, chunk_no, min(ordinal) as lo, max(ordinal) as hi from r group by 1, 2),
g as (select doc_id, ordinal as first, ordinal + 1 as last, content as text from s),
h as (select c.*, first, last, text from c join g using (doc_id) where last >= lo and first <= hi),
k as (select doc_id, chunk_no, count(distinct u) / (any_value(hi) - any_value(lo) + 1) as share from (select *, unnest(range(greatest(first, lo), least(last, hi) + 1)) as u from h) group by 1, 2)
select doc_id as text_id, chunk_no::bigint as chunk_no, sha256(string_agg(text, ' ' order by first, last)) as text_sha256 from h join k using (doc_id, chunk_no) where share >= 0.5 group by 1, 2""")
def chunk_renderings(spark, d):
    s = _lines(spark, d)
    chunks = segments.greedy_chunks(s).select(F.col("doc_id").alias("text_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "first_ordinal", "last_ordinal")
    given = s.select(F.col("doc_id").alias("text_id"), F.col("ordinal").alias("first"), (F.col("ordinal") + 1).alias("last"), F.lit(0).alias("reading_order"), F.col("content").alias("text"))
    return citing.covered_renderings(given, chunks).select("text_id", "chunk_no", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(r"""with p as (select distinct regexp_extract(url, '^(https?://[^/]+)', 1) as prefix, 'host' as label from pages union select distinct regexp_extract(url, '^(https?://[^/]+/[^/?]+)/', 1), 'section' from pages),
m as (select u.url, p.label, row_number() over (partition by url order by length(prefix) desc) as k from (select distinct url from pages) u join p on prefix <> '' and (u.url = prefix or starts_with(u.url, prefix || '/')))
select page_id, label from pages left join m on pages.url = m.url and k = 1""")
def licence_prefix(spark, d):
    pages = table(spark, d, "pages")
    host, section = (F.regexp_extract("url", p, 1) for p in (r"^(https?://[^/]+)", r"^(https?://[^/]+/[^/?]+)/"))
    prefixes = pages.select(host.alias("prefix"), F.lit("host").alias("label")).union(pages.select(section, F.lit("section"))).where("prefix <> ''").distinct()
    return relations.longest_prefix(pages.select("page_id", F.col("url").alias("path")), prefixes).select("page_id", "label")


@query("""with recursive e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem), u as (select a, b from e union select b, a from e),
w as (select 's1' as node, 0 as hop union select u.b, hop + 1 from w join u on w.node = u.a where hop < 2)
select node, min(hop)::bigint as hop from w group by node""")
def bounded_expansion(spark, d):
    rows = table(spark, d, "lineitem")
    edges = rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    seeds = spark.createDataFrame([("s1",)], "node string")
    return relations.expand(seeds, edges, 2).select("node", F.col("hop").cast("long").alias("hop"))


@query("""with w as (select o_orderkey, case when o_orderkey % 5 <> 0 then year(o_orderdate) end as a, case when o_orderkey % 3 = 0 then year(o_orderdate) + 2 end as b, case when o_orderkey % 7 <> 0 then 'colophon' end as basis from orders)
select o_orderkey from w where basis is not null and coalesce(b, a) >= 1997 and coalesce(a, b) <= 1998""")
def composed_between(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    works = table(spark, d, "orders").select("o_orderkey", F.when(k % 5 != 0, y).alias("date_start"), F.when(k % 3 == 0, y + 2).alias("date_end"), F.when(k % 7 != 0, "colophon").alias("date_basis"))
    return lexical.composed(works, 1997, 1998).select("o_orderkey")


@query("select vec_id from embeddings where ('0x' || left(md5(vec_id::varchar), 6))::bigint % 100 < 30")
def ablation_keep(spark, d):
    return lexical.ablated(table(spark, d, "embeddings"), "vec_id", 30).select("vec_id")


@query(f"""with {SEG} select doc_id, count(*) as lines, count(*) filter (where content <> '') as printed, count(*) filter (where content = '') as blank, max(char_start + length(content)) = any_value(n_chars) as whole
from seg join documents using (doc_id) group by doc_id""")
def integrity_reconcile(spark, d):
    """Every line of a document is a segment or blank, and the last one ends where the document does."""
    docs = table(spark, d, "documents")
    lines = F.split("text", "\n")
    printed = segments.segment_lines(docs).groupBy("doc_id").agg(F.count("*").alias("printed"))
    rows = docs.join(printed, "doc_id", "left").select("doc_id", F.size(lines).cast("long").alias("lines"), F.coalesce("printed", F.lit(0)).alias("printed"), (F.aggregate(lines, F.lit(-1).cast("long"), lambda n, x: n + F.length(x) + 1) == F.col("n_chars")).alias("whole"))
    return rows.withColumn("blank", F.col("lines") - F.col("printed"))


@query("select doc_id, strlen(text)::bigint as bytes, strlen(text) <= 200000 as accepted from documents")
def input_bounds(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").select("doc_id", size.cast("long").alias("bytes"), ((size <= 200_000) & F.is_valid_utf8("text")).alias("accepted"))


@query(r"""with p as (select doc_id, unnest(string_split(text, chr(10))) as paragraph from documents) select doc_id, count(*) as uncited from p
where regexp_matches(paragraph, '[0-9]') and not regexp_matches(paragraph, '[a-z]+\d*:\d+@l\d+') group by doc_id""")
def figures_without_citation(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("paragraph"))
    return p.where(F.col("paragraph").rlike("[0-9]") & ~F.col("paragraph").rlike(r"[a-z]+\d*:\d+@l\d+")).groupBy("doc_id").agg(F.count("*").alias("uncited"))


@query("select doc_id, source from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def review_queue(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def _roman(n: int) -> str:
    out = ""
    for value, letters in ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + letters, n - value
    return out


@query("select p_partkey, p_size::bigint as volume, (p_partkey % 90 + 1)::bigint as first, (p_partkey % 90 + 1 + p_partkey % 3)::bigint as last from part")
def parallel_anchors(spark, d):
    roman = F.element_at(F.array(*[F.lit(_roman(n)) for n in range(1, 60)]), F.col("p_size"))
    first = F.col("p_partkey") % 90 + 1
    last = first + F.col("p_partkey") % 3
    anchor = F.concat(F.lit("S "), roman, F.lit(" "), first.cast("string"), F.when(first == last, "").otherwise(F.concat(F.lit("-"), last.cast("string"))))
    got = table(spark, d, "part").select("p_partkey", anchor.alias("anchor")).select("p_partkey", citing.volpage(F.col("anchor")).alias("v"))
    return got.select("p_partkey", *[F.col(f"v.{c}").cast("long").alias(c) for c in ("volume", "first", "last")])


@query("""with q as (select item_id, text, substring(text, 10, 25) as quote from benchmark) select item_id, case when (length(text) - length(replace(text, quote, ''))) = length(quote) then strpos(text, quote)::bigint - 1 end as place from q""")
def quote_alignment(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text", F.substring("text", 10, 25).alias("quote"))
    return rows.select("item_id", citing.quote_in_source(F.col("quote"), F.col("text")).cast("long").alias("place"))


#: What the titles of genre_relations end in: roots, commentaries, commentaries on an ornament (rgyan), a ritual.
ENDS = ["", "་ཚིག་ལེའུར་བྱས་པ", "འི་འགྲེལ་པ", "་གྱི་འགྲེལ་བཤད", "་ཀྱི་བཤད་པ་ཞེས་བྱ་བ", "་ཆོ་ག", "འི་དཀའ་འགྲེལ", "་གྱི་རྒྱན", "་གྱི་རྒྱན་གྱི་འགྲེལ་བཤད"]


@query(f"""with t as (select distinct p_type || case when p_partkey % 2 = 0 then '་' || p_name else '' end || ({ENDS})[p_partkey % 9 + 1] as title from part),
b as (select title, regexp_replace(title, '(་?(ཞེས|ཅེས|ཞེའོ)་བྱ་བ)+$', '') as bare from t),
s as (select * from (values (0, '', 0), {", ".join(f"({i + 1}, '{g}', {depth})" for i, (g, depth) in enumerate(citing.GENRES.items()))}) v(place, suffix, depth)),
n as (select *, row_number() over (partition by title order by place = 0, place) as k from b join s on ends_with(bare, suffix) and (place = 0 or not regexp_matches(bare, 'སྒྲུབ་ཐབས|ཆོ་ག|བསྟོད་པ|སྔགས|མན་ངག'))),
f as (select title, place > 0 as named, depth, regexp_replace(regexp_replace(bare, '་?(གྱི|ཀྱི|གི|ཡི|འི)$', ''), '་+$', '') as whole, regexp_replace(regexp_replace(regexp_replace(left(bare, length(bare) - length(suffix)), '་+$', ''), '་?(གྱི|ཀྱི|གི|ཡི|འི)$', ''), '་+$', '') as stem from n where k = 1),
p as (select c.title, r.title as explains, r.named, r.depth, r.whole = c.stem and not r.named as bare, rank() over (partition by c.title order by strlen(r.whole) desc) as k from f c join f r on c.named and r.whole <> c.whole and starts_with(c.stem, r.whole)),
q as (select c.title, r.title as explains, r.named, r.depth, rank() over (partition by c.title order by r.depth desc) as k from f c join f r on c.named and r.stem = c.stem and r.depth < c.depth),
x as (select title, explains, named, depth from p where k = 1 and not (bare and title in (select title from q where depth > 0))),
y as (from x union all select title, explains, named, depth from q where k = 1 and title not in (select title from x))
select title, explains, case when named and depth > 0 then 'subcommentary_of' else 'comments_on' end as relation, case when count(*) over (partition by title) > 1 then 'uncertain' else 'probable' end as confidence from y""")
def genre_relations(spark, d):
    end = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (F.col("p_partkey") % 9 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("་"), "p_name")).otherwise("")
    return citing.genre_relations(table(spark, d, "part").select(F.concat("p_type", name, end).alias("title"))).drop("work", "parent")
