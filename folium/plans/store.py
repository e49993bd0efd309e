"""Stored corpora, vector rows, relations and alignments, glossaries, cases: each operator on rows made from the test tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folium.operators import commentary, finding, glossary, identity, lexical, relations, segments, semantic, vectors
from folium.plans.corpus import PHRASE, SEG, _hits_sql
from folium.plans.registry import query
from folium.plans.reusing import FOUND, _found
from folium.session import shared_folder
from folium.sources.tables import table

TERMS = finding.dictionary_words("thethingandxing", frozenset({"the", "thing", "and", "ing", "th"}), frozenset({"and"}))


@query(f"with {SEG}, p as ({_hits_sql([PHRASE])}), t as ({_hits_sql(['the', 'thing'])}), g as ({_hits_sql([PHRASE], '(select * from s where source in (select source from s where source is not null order by source limit 1))')}) select 'phrase' as mode, * from p union all select 'terms', * from t union all select 'scoped', * from g")
def stored_search(spark, d):
    """Three modes over a corpus that is cut once and stored."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    finding.write_corpus(docs, folder)
    corpus = finding.read_corpus(spark, folder)
    least = docs.agg(F.min("source")).first()[0]
    named = lambda hits, name: hits.withColumn("mode", F.lit(name))
    rows = named(finding.search(corpus, PHRASE, "phrase"), "phrase").unionByName(named(finding.search(corpus, "the thing", "terms"), "terms"))
    return rows.unionByName(named(finding.search(corpus, PHRASE, "phrase", lexical.Scope(sources=(least,))), "scoped"))


@query(f"with {SEG} {_hits_sql(['the', 'thing', 'ing'])}")
def terms_search(spark, d):
    """Words of an unspaced query by a dictionary: the, thing, ing."""
    docs = finding.holding(table(spark, d, "documents"), TERMS)
    return lexical._scored(segments.segment_lines(docs), TERMS, 20)


@query("""with b as (select o_orderkey as id, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders), f as (select o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 20)
select count(*) as promoted from f where id not in (select id from b where rank <= 5000)""")
def promoted_count(spark, d):
    o = table(spark, d, "orders")
    before = lexical.ranked(o.select(F.col("o_orderkey").alias("id"), "o_totalprice"), [F.col("o_totalprice").desc(), F.col("id")], 5000)
    final = o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"))
    return finding.promoted(final, before, "id", 5000)


def _chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk"), "source", F.col("text").alias("content"), "lang")


@query("""select doc_id as chunk, 'source' as kind, case source when 'src1' then 'pi' when 'src2' then 'bo' else 'lzh' end as lang, null::varchar as translator, sha256(coalesce(text, '')) as sha256 from documents""")
def source_vector_rows(spark, d):
    return vectors.source_rows(_chunks(spark, d), {"src1": "pi", "src2": "bo"}, "lzh")


HELD_SQL = """w as (select doc_id as chunk, 'source' as kind, lang, case when doc_id % 3 = 0 then null else 'hand' || doc_id % 3 end as translator, sha256(coalesce(text, '')) as sha256 from documents),
h as (select doc_id as chunk, 'source' as kind, lang, case when doc_id % 3 = 0 then null else 'hand' || doc_id % 3 end as translator, case when doc_id % 7 = 0 then 'old' else sha256(coalesce(text, '')) end as sha256,
  case when doc_id % 5 <> 0 then doc_id end as embedding, case when doc_id % 11 = 0 then 'other' else 'm1' end as model, case when doc_id % 13 = 0 then 256 else 512 end as "window" from documents where doc_id % 4 <> 0)"""


def _held(spark, d):
    k = F.col("chunk")
    wanted = _chunks(spark, d).select("chunk", F.lit("source").alias("kind"), "lang", F.when(k % 3 != 0, F.concat(F.lit("hand"), (k % 3).cast("string"))).alias("translator"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("sha256"))
    held = wanted.where(k % 4 != 0).withColumn("sha256", F.when(k % 7 == 0, "old").otherwise(F.col("sha256"))).withColumn("embedding", F.when(k % 5 != 0, k))
    return held.withColumn("model", F.when(k % 11 == 0, "other").otherwise("m1")).withColumn("window", F.when(k % 13 == 0, 256).otherwise(512)), wanted


@query(f"""with {HELD_SQL}, v as (select * from w where chunk % 9 <> 1)
select coalesce(h.chunk, v.chunk) as chunk, coalesce(h.kind, v.kind) as kind, coalesce(h.lang, v.lang) as lang, coalesce(h.translator, v.translator) as translator,
  case when h.chunk is null then 'missing' when v.chunk is null then 'orphan' when h.sha256 = v.sha256 then 'current' else 'stale' end as state
from h full join v on h.chunk = v.chunk and h.kind = v.kind and h.lang is not distinct from v.lang and h.translator is not distinct from v.translator""")
def vector_state(spark, d):
    held, wanted = _held(spark, d)
    return vectors.state(held, wanted.where("chunk % 9 <> 1"))


@query(f"""with {HELD_SQL} select chunk from h where embedding is null or model <> 'm1' or "window" <> 512""")
def vectors_pending(spark, d):
    return vectors.pending(_held(spark, d)[0], "m1", 512).select("chunk")


@query(f"""with {HELD_SQL} select count(*) as lost, count(*) = 0 as allowed from h where embedding is not null and not exists (select 1 from w where w.chunk = h.chunk and w.sha256 = h.sha256)""")
def rebuild_guard(spark, d):
    return vectors.rebuild_loss(*_held(spark, d))


SCOPED_SQL = """v as (select doc_id as chunk, case doc_id % 4 when 0 then 'source' when 1 then 'parallel' else 'translation' end as kind, lang, case when doc_id % 4 > 1 then 'hand' || doc_id % 3 end as translator, source from documents)"""


def _rows(spark, d):
    k = F.col("chunk")
    kind = F.when(k % 4 == 0, "source").when(k % 4 == 1, "parallel").otherwise("translation")
    return _chunks(spark, d).select("chunk", kind.alias("kind"), "lang", F.when(k % 4 > 1, F.concat(F.lit("hand"), (k % 3).cast("string"))).alias("translator"), "source")


@query(f"""with {SCOPED_SQL} select chunk, kind from v where kind in ('source', 'translation') and lang in ('en', 'de') and (kind <> 'translation' or (translator in ('hand1', 'hand2') and chunk in (select p_partkey from part where p_size < 25)))""")
def vector_scope(spark, d):
    allowed = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("chunk"))
    return vectors.scoped(_rows(spark, d), langs=("en", "de"), translators=("hand1", "hand2"), allowed=allowed).select("chunk", "kind")


@query(f"""with {SCOPED_SQL}, l as (select distinct source, case when source in ('src0', 'src3') then 'open' when source = 'src1' then 'noncommercial' end as license_class from documents where source is not null)
select v.chunk from v join l using (source) where license_class in ('open', 'public')""")
def licence_scope(spark, d):
    rows = _rows(spark, d)
    licences = rows.select("source").where("source is not null").distinct().withColumn("license_class", F.when(F.col("source").isin("src0", "src3"), "open").when(F.col("source") == "src1", "noncommercial"))
    return vectors.licensed(rows, licences, ("open", "public")).select("chunk")


@query("""with r as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'approved' when '2-HIGH' then 'reviewed' when '3-MEDIUM' then 'draft' end as state, o_orderkey % 2 = 0 as attested from orders)
select o_orderkey, state from r where state in ('reviewed', 'approved') and attested""")
def review_floor(spark, d):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "approved").when(F.col("o_orderpriority") == "2-HIGH", "reviewed").when(F.col("o_orderpriority") == "3-MEDIUM", "draft")
    rows = table(spark, d, "orders").select("o_orderkey", state.alias("state"), (F.col("o_orderkey") % 2 == 0).alias("attested"))
    return vectors.reviewed(rows, ("draft", "reviewed", "approved"), "reviewed", attested_only=True).select("o_orderkey", "state")


@query("""with l as (select l_orderkey as work, l_linenumber as ordinal, l_partkey as line from lineitem), c as (select o_orderkey as chunk, o_orderkey as work, 1 as first, 3 as last from orders where o_custkey % 3 = 0),
p as (select distinct p_partkey as a, p_partkey % 50 + 1 as b from part), r as (select p_partkey as line, 'hand' || p_partkey % 2 as translator, p_name as text from part),
h as (select distinct chunk, translator, text from c join l on c.work = l.work and l.ordinal between c.first and c.last join p on p.a = l.line join r on r.line = p.b)
select chunk, translator, count(*) as n_texts, string_agg(text, ' / ' order by text) as text from h group by 1, 2""")
def parallel_vector_rows(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    chunks = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("chunk"), F.col("o_orderkey").alias("work"), F.lit(1).alias("first"), F.lit(3).alias("last"))
    lines = li.select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").cast("int").alias("ordinal"), F.col("l_partkey").alias("line"))
    parallels = part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % 50 + 1).alias("b"))
    texts = part.select(F.col("p_partkey").alias("line"), F.concat(F.lit("hand"), (F.col("p_partkey") % 2).cast("string")).alias("translator"), F.col("p_name").alias("text"))
    return vectors.parallel_rows(chunks, lines, parallels, texts)


@query("""select r_name, n_name as customer_nation, m.n_name as supplier_nation, count(*) as lines, count(distinct p_brand) as brands
from region join nation n on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey join nation m on s_nationkey = m.n_nationkey group by 1, 2, 3""".replace("n_name as customer_nation", "n.n_name as customer_nation"))
def provenance_chain(spark, d):
    """A chain of seven joins, from region to the supplier's nation."""
    t = lambda name: table(spark, d, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("supplier_nation")), F.col("s_nationkey") == F.col("k"))
    return rows.groupBy("r_name", F.col("n_name").alias("customer_nation"), "supplier_nation").agg(F.count("*").alias("lines"), F.count_distinct("p_brand").alias("brands"))


@query("""with c as (select distinct conv_id as chunk, conv_id as work, 0 as first, 2 as last from conversations), p as (select conv_id as work, turn as ordinal, role as translator from conversations where turn > 1),
g as (select distinct conv_id as work, 2 as first, 4 as last, 'range' as translator from conversations where conv_id % 2 = 0),
u as (select work, ordinal, translator from p union select work, unnest(range(first, last + 1)), translator from g)
select translator, count(distinct chunk) as chunks from c join u using (work) where ordinal between first and last group by translator""")
def chunks_covered(spark, d):
    c = table(spark, d, "conversations")
    chunks = c.select(F.col("conv_id").alias("chunk"), F.col("conv_id").alias("work"), F.lit(0).cast("long").alias("first"), F.lit(2).cast("long").alias("last")).distinct()
    points = c.where("turn > 1").select(F.col("conv_id").alias("work"), F.col("turn").cast("long").alias("ordinal"), F.col("role").alias("translator"))
    ranges = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("work"), F.lit(2).cast("long").alias("first"), F.lit(4).cast("long").alias("last"), F.lit("range").alias("translator")).distinct()
    return vectors.covered_chunks(chunks, points, ranges)


@query("""with r as (select c_nationkey as item, c_name as hand from customer where c_acctbal > 5000), a as (select *, 0 as repeat from r union all select *, 1 from r where ('0x' || left(md5('s|again|' || item), 6))::bigint % 100 < 40)
select item, repeat, md5('s|place|' || item || '|' || repeat) as place, chr((64 + row_number() over (partition by item, repeat order by md5('s|' || item || '|' || hand || '|' || repeat), hand))::int) as letter, hand from a""")
def blinded_sheet(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("item"), F.col("c_name").alias("hand"))
    return vectors.blinded_sheet(rows, "item", "hand", "s", 40)


@query("""with r as (select l_orderkey, l_linenumber::bigint as line, l_extendedprice as score, 'price' as arm from lineitem union all select l_orderkey, l_linenumber, l_quantity * 1000.0, 'quantity' from lineitem)
select l_orderkey, line, arm, row_number() over (order by score desc, arm, l_orderkey, line) as rank from r qualify rank <= 40""")
def two_armed_top(spark, d):
    li = table(spark, d, "lineitem")
    arm = lambda score, name: li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), score.cast("double").alias("score"), F.lit(name).alias("arm"))
    order = [F.col("score").desc(), F.col("arm"), F.col("l_orderkey"), F.col("line")]
    arms = [lexical.ranked(arm(s, n), order, 40).drop("rank") for s, n in ((F.col("l_extendedprice"), "price"), (F.col("l_quantity") * 1000.0, "quantity"))]
    return lexical.ranked(arms[0].unionByName(arms[1]), order, 40).select("l_orderkey", "line", "arm", "rank")


@query("select event_id from events order by md5('pick' || event_id::varchar), event_id limit 25")
def hash_pick(spark, d):
    return identity.seeded_sample(table(spark, d, "events").select("event_id"), "event_id", 25, "pick")


@query("""select coalesce(lang, '-') as lang, coalesce(source, '-') as source, count(*) as works, sum(length(coalesce(text, '')))::bigint as chars, count(distinct text) as witnesses from documents group by 1, 2""")
def inventory(spark, d):
    name = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return table(spark, d, "documents").groupBy(name("lang"), name("source")).agg(F.count("*").alias("works"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count_distinct("text").alias("witnesses"))


@query("""select conv_id as work, turn::bigint as place, role as heading, length(text)::bigint as size from conversations""")
def outline_rows(spark, d):
    """An outline stored as JSON, one object a heading, back as rows."""
    item = F.struct(F.col("turn").cast("long").alias("place"), F.col("role").alias("heading"), F.length("text").cast("long").alias("size"))
    stored = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("work")).agg(F.to_json(F.collect_list(item)).alias("outline"))
    rows = stored.select("work", F.explode(F.from_json("outline", "array<struct<place:long,heading:string,size:long>>")).alias("o"))
    return rows.select("work", "o.*")


@query("select doc_id, length(coalesce(text, ''))::bigint as chars, coalesce(n_chars, -1) <> length(coalesce(text, '')) as changed from documents")
def char_counts(spark, d):
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("chars"), (F.coalesce("n_chars", F.lit(-1)) != n).alias("changed"))


@query(f"""with {SEG}, {FOUND}, h as (select item_id, doc_id, start, length, first_value(line_no) over w as a, last_value(line_no) over w as b, any_value(source) over w as source
  from f left join s using (doc_id) where char_start < start + length and char_start + length(content) > start window w as (partition by item_id, doc_id, start order by ordinal rows between unbounded preceding and unbounded following))
select item_id, f.doc_id, start, case when h.a is null then null when h.a = h.b then source || ':' || f.doc_id || '@l' || h.a else source || ':' || f.doc_id || '@l' || h.a || '-l' || h.b end as urn from f left join (select distinct * from h) h using (item_id, doc_id, start)""")
def quotation_addresses(spark, d):
    """Each match's address: from the first to the last segment that it touches; null where it touches none."""
    from folium.functions import urn
    from folium.operators import reuse

    s = segments.segment_lines(table(spark, d, "documents"), ("source",))
    found = _found(spark, d)
    spans = reuse.overlapping(found, s).groupBy("item_id", "doc_id", "start").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.first("source").alias("source"))
    line = lambda c: F.concat(F.lit("l"), F.col(c).cast("string"))
    named = spans.select("item_id", "doc_id", "start", urn.span(F.col("source"), F.col("doc_id"), line("a"), line("b")).alias("urn"))
    return found.select("item_id", "doc_id", "start").join(named, ["item_id", "doc_id", "start"], "left")


REL_SQL = """rel as (select 'w' || l_suppkey % 60 as source, case when l_partkey % 17 <> 0 then 'w' || l_partkey % 60 end as target, case when l_partkey % 17 = 0 then 'ref' || l_partkey % 5 end as ref,
  case l_linenumber when 1 then 'comments_on' when 2 then 'subcommentary_of' else 'parallel_to' end as relation, 'catalogue' as method, l_orderkey as "at" from lineitem)"""


def _relations(spark, d):
    name = lambda c: F.concat(F.lit("w"), (F.col(c) % 60).cast("string"))
    kind = F.when(F.col("l_linenumber") == 1, "comments_on").when(F.col("l_linenumber") == 2, "subcommentary_of").otherwise("parallel_to")
    open_ = F.col("l_partkey") % 17 == 0
    return table(spark, d, "lineitem").select(name("l_suppkey").alias("source"), F.when(~open_, name("l_partkey")).alias("target"), F.when(open_, F.concat(F.lit("ref"), (F.col("l_partkey") % 5).cast("string"))).alias("ref"), kind.alias("relation"), F.lit("catalogue").alias("method"), F.col("l_orderkey").alias("at"))


@query(f"""with {REL_SQL}, a as (select * from rel where (target is not null or ref is not null) and coalesce(target <> source, true))
select source, target, ref, relation, method, max("at") as "at" from a group by all""")
def relations_asserted(spark, d):
    """Relations that are stored already (of odd orders, valid ones only) and incoming ones, which have earlier and later versions of them."""
    rows = _relations(spark, d)
    stored = rows.where("at % 2 = 1 and (target is not null or ref is not null) and coalesce(target <> source, true)")
    return commentary.asserted(stored, rows.where("at % 2 = 0"))


@query(f"""with {REL_SQL}, e as (select distinct source, target, relation from rel), u as (
  select source as work, 0 as below, (relation <> 'parallel_to')::int as up, (relation = 'parallel_to')::int as par from e union all select target, (relation <> 'parallel_to')::int, 0, (relation = 'parallel_to')::int from e where target is not null)
select work, sum(below)::bigint as commentaries, sum(up)::bigint as explains, sum(par)::bigint as parallels, sum(up) > 0 as explanatory from u group by work""")
def relation_neighbours(spark, d):
    return commentary.neighbours(_relations(spark, d).select("source", "target", "relation").distinct())


@query(f"""with {REL_SQL}, h as (select distinct 'w' || s_suppkey % 60 as work from supplier where s_nationkey < 20)
select distinct source, target from rel where relation <> 'parallel_to' and source in (select work from h) and target in (select work from h)""")
def pairs_to_align(spark, d):
    works = table(spark, d, "supplier").select(F.concat(F.lit("w"), (F.col("s_suppkey") % 60).cast("string")).alias("work"), F.when(F.col("s_nationkey") < 20, "allowed").otherwise("not").alias("source_id"))
    return commentary.pairs_to_align(_relations(spark, d), works, ("allowed",))


GLOSS_SQL = """g as (select l_suppkey as work, l_partkey % 40 as first, l_partkey % 40 + l_linenumber - 1 as last, l_orderkey * 10 + l_linenumber as gloss, l_quantity::bigint as length, l_discount > 0.04 as reviewed, l_orderkey % 9 as commentary from lineitem)"""


def _glosses(spark, d):
    li = table(spark, d, "lineitem")
    first = F.col("l_partkey") % 40
    return li.select(F.col("l_suppkey").alias("work"), first.alias("first"), (first + F.col("l_linenumber") - 1).alias("last"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gloss"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_discount") > 0.04).alias("reviewed"), (F.col("l_orderkey") % 9).alias("commentary"))


@query(f"""with {GLOSS_SQL}, a as (select s_suppkey as work, 7::bigint as ordinal from supplier)
select g.work, ordinal, gloss, length, row_number() over (partition by g.work, ordinal order by length desc, gloss) as place, not reviewed as to_review from g join a on g.work = a.work and ordinal between first and last""")
def glosses_on_line(spark, d):
    return commentary.glosses_on(_glosses(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), F.lit(7).cast("long").alias("ordinal")))


@query(f"""with {GLOSS_SQL}, v as (select s_suppkey as work, k as division, k * 10 as lo, k * 10 + 9 as hi from supplier, range(0, 4) t(k)), o as (select *, unnest(range(lo, hi + 1)) as ordinal from v)
select o.work, division, count(distinct gloss) as glosses, count(distinct ordinal) as lines, count(distinct commentary) as commentaries from o join g on g.work = o.work and ordinal between first and last group by 1, 2""")
def alignment_outline(spark, d):
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), k.alias("division")).select("work", "division", (F.col("division") * 10).alias("lo"), (F.col("division") * 10 + 9).alias("hi"))
    return commentary.alignment_outline(_glosses(spark, d), v)


@query("""with f as (select distinct l_suppkey as source, l_partkey % 20 as target, case when l_suppkey % 3 = 0 then 'strong' else 'weak' end as band from lineitem), k as (select distinct s_suppkey as source, s_nationkey % 20 as true from supplier where s_suppkey % 2 = 0)
select band, count(*) as judged, sum((target = true)::int)::bigint as "right", round(sum((target = true)::int) / count(*)::double, 6) as precision from f join k using (source) group by band""")
def precision_by_band(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 20).alias("target"), F.when(F.col("l_suppkey") % 3 == 0, "strong").otherwise("weak").alias("band")).distinct()
    known = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") % 20).cast("long").alias("target"))
    return commentary.precision_by_band(found, known)


@query("""with a as (select p_partkey as work from part where p_size = 7), r as (select l_partkey as work, 'hand' || l_suppkey % 4 as translator from lineitem), x as (select p_partkey as a, p_partkey % 30 + 1 as b from part),
e as (select p_partkey as work, 'ed' || p_size % 3 as edition from part)
select work::varchar as work, 'rendering' as kind, translator as other, count(*) || ' passages' as note from r where work in (select work from a) group by work, translator
union all select work::varchar, 'parallel', other::varchar, 'another text' from (select a as work, b as other from x union select b, a from x) where work in (select work from a) union all select distinct work::varchar, 'alternate', edition, 'the same text' from e where work in (select work from a)""")
def versions_compared(spark, d):
    part = table(spark, d, "part")
    r = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("work"), F.concat(F.lit("hand"), (F.col("l_suppkey") % 4).cast("string")).alias("translator"))
    key = F.col("p_partkey").cast("string")
    x = part.select(key.alias("a"), (F.col("p_partkey") % 30 + 1).cast("string").alias("b"))
    e = part.select(key.alias("work"), F.concat(F.lit("ed"), (F.col("p_size") % 3).cast("string")).alias("edition"))
    return commentary.versions(part.where("p_size = 7").select(key.alias("work")), r, x, e)


@query("""with w as (select n_name as name, 'v1' as version, md5(n_name) as input_digest, md5(n_name || 'o') as output_digest, n_nationkey::bigint as n from nation),
r as (select name, input_digest, n, n % 7 <> 2 as complete, case when n % 7 = 3 then 'v0' else 'v1' end as version, case when n % 7 = 4 then 'x' else output_digest end as output_digest from w where n % 7 <> 1)
select w.name, coalesce(r.complete and r.version = w.version and r.input_digest = w.input_digest and r.output_digest = w.output_digest and r.n = w.n, false) as ready,
  case when r.name is null then 'no_receipt' when not r.complete then 'incomplete' when r.version <> w.version then 'version' when r.output_digest <> w.output_digest then 'output_digest' end as problem from w left join r using (name)""")
def derivations_ready(spark, d):
    n = F.col("n_nationkey").cast("long")
    w = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("v1").alias("version"), F.md5(F.col("n_name").cast("binary")).alias("input_digest"), F.md5(F.concat("n_name", F.lit("o")).cast("binary")).alias("output_digest"), n.alias("n"))
    k = F.col("n") % 7
    r = w.where(k != 1).withColumn("complete", k != 2).withColumn("version", F.when(k == 3, "v0").otherwise(F.col("version"))).withColumn("output_digest", F.when(k == 4, "x").otherwise(F.col("output_digest")))
    return commentary.readiness(w, r)


@query("""with recursive t as (select l_suppkey % 90 as person, min(l_partkey % 83) as teacher, count(distinct l_partkey % 83) as branches from lineitem where l_orderkey % 40 = 1 group by 1), p as (select distinct l_suppkey % 90 as person from lineitem),
w as (select person as start, 0 as hop, person, [person] as path from p union all select start, hop + 1, teacher, list_append(path, teacher) from w join t using (person) where hop < 10 and not list_contains(path, teacher))
select start, hop::bigint as hop, person, coalesce(branches, 0) as branches, case when teacher is null then 'end' when list_contains(path, teacher) then 'cycle' when hop = 10 then 'limit' end as stopped from w left join t using (person)""")
def lineage_chain(spark, d):
    li = table(spark, d, "lineitem")
    teachers = li.where("l_orderkey % 40 = 1").select((F.col("l_suppkey") % 90).alias("person"), (F.col("l_partkey") % 83).alias("teacher"))
    return commentary.lineage(li.select((F.col("l_suppkey") % 90).alias("person")).distinct(), teachers)


ENTRIES_SQL = """e as (select p_name as term, p_type as rendering, p_size % 5 = 0 as rejected, p_size % 2 = 0 as verified, p_partkey as "at" from part)"""


def _entries(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("rendering"), (F.col("p_size") % 5 == 0).alias("rejected"), (F.col("p_size") % 2 == 0).alias("verified"), F.col("p_partkey").alias("at"))


@query(f"""with {ENTRIES_SQL}, a as (select distinct upper(p_name) as term from part union select 'unheard of'), c as (select lower(trim(term)) as key, rendering, bool_or(verified) as verified, count(*) as n from e where not rejected group by 1, 2),
r as (select *, count(*) over (partition by key) - 1 as alternatives from c qualify row_number() over (partition by key order by verified desc, n desc, rendering) = 1)
select a.term, rendering, case when rendering is null then 'absent' when verified then 'preferred' else 'unverified' end as status, coalesce(alternatives, 0)::bigint as alternatives from a left join r on lower(trim(a.term)) = key""")
def glossary_lookup(spark, d):
    e = _entries(spark, d)
    asked = e.select(F.upper("term").alias("term")).union(spark.createDataFrame([("unheard of",)], "term string"))
    return glossary.lookup(e, asked)


@query(f"with {ENTRIES_SQL} select count(*) as entries, count(distinct lower(trim(term))) as terms, sum(rejected::int)::bigint as rejected, sum((not verified)::int)::bigint as unverified from e")
def glossary_stats(spark, d):
    return glossary.stats(_entries(spark, d))


@query(f"""with {ENTRIES_SQL}, l as (select lower(trim(term)) as term, arg_min(rendering, "at") as "left" from e where "at" % 2 = 0 group by 1), r as (select lower(trim(term)) as term, arg_min(rendering, "at") as "right" from e where "at" % 2 = 1 group by 1)
select term, "left", "right", lower("left") = lower("right") as agreed from l join r using (term)""")
def glossary_agreement(spark, d):
    e = _entries(spark, d).withColumnRenamed("rendering", "value")
    return glossary.agreement(e.where("at % 2 = 0"), e.where("at % 2 = 1"))


@query("""with x as (select distinct 'W' || l_suppkey % 30 as work, l_partkey % 20 as page, 'a' as register, l_linenumber::bigint as line from lineitem), m as (select work, page, register, max(line) as last from x group by all),
e as (select p_partkey as entry, 'W' || p_partkey % 40 as work, p_partkey % 25 as page, case when p_partkey % 3 = 0 then '-' else '' end as sign, p_size % 8 as asked, p_partkey % 11 = 0 as bad from part),
f as (select entry, case when bad then 'no address' else e.work || ':' || e.page || 'a' || sign || asked end as citation, e.work, e.page, bad, case when sign = '-' then last - asked + 1 else asked end as line from e left join m on m.work = e.work and m.page = e.page)
select entry, citation, case when not bad and x.work is not null then f.work || '/' || f.page || '/' || f.line end as urn, case when bad then 'malformed' when f.work not in (select work from x) then 'absent' when x.work is null then 'unresolved' end as problem
from f left join x on x.work = f.work and x.page = f.page and x.line = f.line""")
def glossary_anchors(spark, d):
    w = lambda c, n: F.concat(F.lit("W"), (F.col(c) % n).cast("string"))
    lines = table(spark, d, "lineitem").select(w("l_suppkey", 30).alias("work"), (F.col("l_partkey") % 20).alias("page"), F.lit("a").alias("register"), F.col("l_linenumber").cast("long").alias("line")).distinct()
    lines = lines.withColumn("urn", F.concat_ws("/", "work", F.col("page").cast("string"), F.col("line").cast("string")))
    sign = F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("")
    cited = F.when(F.col("p_partkey") % 11 == 0, "no address").otherwise(F.concat(w("p_partkey", 40), F.lit(":"), (F.col("p_partkey") % 25).cast("string"), F.lit("a"), sign, (F.col("p_size") % 8).cast("string")))
    return glossary.cited_anchors(table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.array(cited).alias("citations")), lines)


@query("""with p as (select u.conv_id || '/' || u.turn as key, u.text as source, a.text as target from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user')
select key, source, target, round(length(target) / length(source)::double, 6) as ratio from p where length(source) >= 60 and length(target) >= 60 and length(target) / length(source)::double between 0.4 and 4.0""")
def training_pairs(spark, d):
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    given = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    pairs = asked.join(given, ["conv_id", "turn"]).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "source", "target")
    return glossary.training_pairs(pairs)


@query("""with c as (select o_orderkey as case_id, case o_orderkey % 3 when 0 then 'exact' when 1 then 'range' else 'absent' end as kind, o_custkey % 12 as work, o_orderkey % 30 as first, o_orderkey % 30 + 2 as last, 3 as k from orders),
f as (select l_orderkey as case_id, l_linenumber as rank, l_suppkey % 12 as work, l_partkey % 30 as first, l_partkey % 30 + l_linenumber % 4 as last from lineitem),
h as (select c.case_id, kind, min(rank) filter (where rank <= k and f.work = c.work and f.first <= c.last and f.last >= c.first and (kind <> 'exact' or (f.first = c.first and f.last = c.last))) as rank from c left join f using (case_id) group by 1, 2)
select case_id, kind, case when (kind = 'absent') = (rank is null) then 'hit' else 'miss' end as outcome, rank from h""")
def gold_cases_scored(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    k = F.col("o_orderkey")
    cases = o.select(k.alias("case_id"), F.when(k % 3 == 0, "exact").when(k % 3 == 1, "range").otherwise("absent").alias("kind"), (F.col("o_custkey") % 12).alias("work"), (k % 30).alias("first"), (k % 30 + 2).alias("last"), F.lit(3).alias("k"))
    found = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 12).alias("work"), (F.col("l_partkey") % 30).alias("first"), (F.col("l_partkey") % 30 + F.col("l_linenumber") % 4).alias("last"))
    return glossary.scored_cases(cases, found)


@query("""with t as (select p_partkey as doc_id, case p_partkey % 4 when 0 then 'sat' when 1 then 'print' when 2 then 'print' else 'sutta' end as form, p_partkey % 900 + 1 as work, p_size as page, ['a', 'b', 'c'][p_partkey % 3 + 1] as register, p_partkey % 29 + 1 as line, p_partkey % 4 as k, p_name from part)
select doc_id, form, case when k = 3 then 'mn' || work else 'T' || lpad(work::varchar, 4, '0') end as work, case when k = 0 then 9 end::bigint as volume, case when k < 3 then page end::bigint as page, case when k < 3 then register end as register,
  case when k < 3 then line end as line, k = 2 as from_foot, case when k = 3 then page || '.' || line end as segment, length(p_name) + 7 as start from t""")
def foreign_citations(spark, d):
    """Citations in texts made of their parts; the SQL gives the parts."""
    from folium.operators import citing

    k, pad = F.col("p_partkey"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    work, line, register = k % 900 + 1, k % 29 + 1, F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int"))
    text = lambda *x: F.concat(F.col("p_name"), F.lit(" as in "), *[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x], F.lit("; T 262 alone."))
    forms = F.when(k % 4 == 0, text("T", pad(work, 4), "_.09.", pad(F.col("p_size"), 4), register, pad(line, 2))).when(k % 4 == 1, text("T. ", work, ", ", F.col("p_size"), register, line)).when(k % 4 == 2, text("T", work, ":", F.col("p_size"), register, "-", line)).otherwise(text("mn", work, ":", F.col("p_size"), ".", line))
    found = citing.foreign_citations(table(spark, d, "part").select(k.alias("doc_id"), forms.alias("text")))
    return found.select("doc_id", "form", "work", "volume", "page", "register", "line", "from_foot", "segment", "start")


@query("""select event_id, user_id, event_type, value from events where value is not null""")
def jsonl_roundtrip(spark, d):
    """Rows written as JSON lines and read again."""
    folder = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").where("value is not null").select("event_id", "user_id", "event_type", "value")
    rows.write.json(folder)
    return spark.read.schema(rows.schema).json(folder)


@query("""select p_name as form, min(p_type) as reading from part group by p_name""")
def tsv_readings(spark, d):
    """Readings written as tab-separated lines under a comment, and read again."""
    folder = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("form")).agg(F.min("p_type").alias("reading"))
    lines = rows.select(F.concat_ws("\t", "form", "reading").alias("value")).union(spark.createDataFrame([("# form, reading",)], "value string"))
    lines.write.text(folder)
    return spark.read.schema("form string, reading string").csv(folder, sep="\t", comment="#", quote="")


@query("""select n_nationkey, sha256('{"languages":["en","pi"],"limit":' || n_nationkey || ',"lock":"' || md5(n_name) || '","version":"1"}') as bake_id from nation""")
def bake_ids(spark, d):
    """The identity of a build: a digest of its lock, version and configuration as JSON with sorted keys."""
    config = F.to_json(F.struct(F.array(F.lit("en"), F.lit("pi")).alias("languages"), F.col("n_nationkey").alias("limit"), F.md5(F.col("n_name").cast("binary")).alias("lock"), F.lit("1").alias("version")))
    return table(spark, d, "nation").select("n_nationkey", F.sha2(config.cast("binary"), 256).alias("bake_id"))


@query(f"with {SEG} {_hits_sql([PHRASE], '(select * from s where doc_id in (select doc_id from documents where doc_id % 4 = 1))')}")
def scope_by_columns(spark, d):
    """A scope over a column of the catalogue, here a division of the texts."""
    docs = table(spark, d, "documents").withColumn("division", F.when(F.col("doc_id") % 4 == 1, "first").otherwise("other"))
    s = segments.segment_lines(finding.holding(docs, [PHRASE]), ("division",))
    return lexical.phrase_search(lexical.Scope(columns=(("division", ("first",)),)).apply(s), PHRASE)


@query(f"""with {SEG}, h as (select doc_id, ordinal, content, length(content) as size from s where contains(content, 'the') and (contains(content, ' is ') or contains(content, ' was ')))
select doc_id, ordinal, content, row_number() over (order by size, doc_id, ordinal) as rank from h qualify rank <= 20""")
def define_term(spark, d):
    """Lines in which a term stands with a formula of definition."""
    from folium.tools import Research

    s = segments.segment_lines(finding.holding(table(spark, d, "documents"), ["the"]))
    return Research(finding.Corpus(s, s)).define_from_canon("the", (" is ", " was "))


@query(f"""with {SEG}, q as (select item_id as quote_id, case item_id % 3 when 0 then split_part(text, '. ', 2) when 1 then left(text, 5) else 'zz' || left(text, 20) end as quote from benchmark),
p as (select quote_id, min((s.doc_id, s.ordinal)) as place from q join s on length(quote) >= 12 and contains(s.content, quote) group by 1)
select quote_id, case when length(quote) < 12 then 'too_short' when place is null then 'not_found' else 'wrong_address' end as reason, place[1] as doc_id, place[2] as ordinal from q left join p using (quote_id)""")
def quotes_misplaced(spark, d):
    from folium.operators import evidence

    k = F.col("item_id") % 3
    quote = F.when(k == 0, F.split_part("text", F.lit(". "), F.lit(2))).when(k == 1, F.substring("text", 1, 5)).otherwise(F.concat(F.lit("zz"), F.substring("text", 1, 20)))
    return evidence.misplaced(table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), quote.alias("quote")), segments.segment_lines(table(spark, d, "documents")))


@query("""with p as (select distinct p_name as term, min(p_type) over (partition by p_name) as rendering from part), t as (select o_orderkey as text_id, 'about ' || p_name || ' and ' || o_clerk as text from orders join part on o_custkey = p_partkey)
select text_id, term, rendering from t join p on contains(text, term) and length(term) >= 3""".replace("o_clerk", "o_orderpriority"))
def pins_for_texts(spark, d):
    from folium.operators import renderings

    part = table(spark, d, "part")
    pinned = part.groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("rendering"))
    texts = table(spark, d, "orders").join(part, F.col("o_custkey") == F.col("p_partkey")).select(F.col("o_orderkey").alias("text_id"), F.concat(F.lit("about "), F.col("p_name"), F.lit(" and "), F.col("o_orderpriority")).alias("text"))
    return renderings.pins_for(texts, pinned)
