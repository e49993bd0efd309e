"""Relations, citations, renderings, identity, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import words
from folium.operators import evidence, identity, receipts, relations, renderings, segments
from folium.plans.corpus import SEG, TOKENS
from folium.plans.registry import query
from folium.session import shared_folder
from folium.sources.tables import table


@query("""with s as (select distinct p_name || ' of ' || lower(p_type) as source from part), t as (select p_name as target from part union select split_part(p_name, ' ', 2) from part),
h as (select source, target, rank() over (partition by source order by length(target) desc) as place from s, t where contains(source, target) and source <> target and length(target) >= 3)
select source, min(target) as target, count(*) as candidates, case when count(*) = 1 then 'certain' else 'ambiguous' end as confidence from h where place = 1 group by source""")
def title_match(spark, d):
    p = table(spark, d, "part")
    sources = p.select(F.concat_ws(" of ", "p_name", F.lower("p_type")).alias("source")).distinct()
    targets = p.select(F.col("p_name").alias("target")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(2)))).distinct()
    return relations.title_match(sources, targets)


@query("""with g as (select o_custkey as work, p_brand as family, count(distinct l_orderkey) as passages, string_agg(distinct p_type, ',' order by p_type) as members
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2),
r as (select *, row_number() over o as place, rank() over (partition by work order by passages desc) as level, coalesce(lead(passages) over o, 0) as runner_up, count(*) over (partition by work) as families
  from g window o as (partition by work order by passages desc, family)),
t as (select *, sum((level = 1)::int) over (partition by work) > 1 as tied from r)
select work, family, passages, runner_up, families, tied, case when tied then 'tied' when passages >= 4 then 'strong' else 'weak' end as band, members from t where place = 1""")
def shared_text_roots(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return relations.dominant_family(lines.select(F.col("o_custkey").alias("work"), F.col("p_type").alias("member"), F.col("p_brand").alias("family"), F.col("l_orderkey").alias("passage")), 4)


@query("""with p as (select l_suppkey % 40 as a, l_partkey % 40 as b, l_discount > 0.05 as partial from lineitem where l_suppkey % 40 <> l_partkey % 40),
c as (select least(a, b) as lo, greatest(a, b) as hi, count(*) filter (where not partial) as n from p group by 1, 2 having n >= 3),
k as (select *, case when n >= 10 then 'probable' else 'possible' end as confidence from c)
select lo as source, hi as target, n, confidence from k union all select hi, lo, n, confidence from k""")
def parallels_to_relations(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"), (F.col("l_discount") > 0.05).alias("partial"))
    return relations.parallels_to_relations(rows).select("source", "target", F.col("n").cast("long").alias("n"), "confidence")


@query("""with recursive e as (select p_partkey % 97 as node, list_sort(list(distinct (p_partkey * 7) % 89)) as ups from part group by 1),
w as (select distinct p_partkey % 97 as start, 0 as hop, p_partkey % 97 as node, [p_partkey % 97] as path from part
  union all select start, hop + 1, up, list_append(path, up) from (select start, hop, path, list_filter(ups, lambda u: not list_contains(path, u))[1] as up from w join e using (node) where hop < 10) where up is not null)
select start, hop::bigint as hop, node, case when ups is null then 'end' when len(list_filter(ups, lambda u: not list_contains(path, u))) = 0 then 'cycle' when hop = 10 then 'limit' end as stopped from w left join e using (node)""")
def resolve_root(spark, d):
    p = table(spark, d, "part")
    edges = p.select((F.col("p_partkey") % 97).alias("node"), ((F.col("p_partkey") * 7) % 89).alias("up"))
    walked = relations.walk_up(p.select((F.col("p_partkey") % 97).alias("start")).distinct(), edges)
    return walked.select("start", F.col("hop").cast("long").alias("hop"), "node", "stopped")


@query("""with w as (select p_brand as family, count(distinct o_custkey) as citing, count(distinct o_custkey || '/' || l_partkey) as weight
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1)
select family, weight, citing, row_number() over (order by weight desc, family) as rank from w""")
def demand_ranking(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy(F.col("p_brand").alias("family")).agg(F.count_distinct("o_custkey").alias("citing"), F.count_distinct("o_custkey", "l_partkey").alias("weight"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.col("weight").desc(), "family")))  # a row per brand


@query("""with n as (select n_nationkey as name_id, n_name as name from nation), t as (select s_suppkey as text_id, 'made in NATION_' || s_nationkey || ' by ' || s_name as text from supplier),
h as (select text_id, name_id, rank() over (partition by text_id order by length(name) desc) as place from t, n where contains(text, name))
select text_id, min(name_id)::bigint as name_id from h where place = 1 group by text_id having count(*) = 1""")
def byline_link(spark, d):
    texts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("text_id"), F.concat(F.lit("made in NATION_"), F.col("s_nationkey").cast("string"), F.lit(" by "), F.col("s_name")).alias("text"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("name_id"), F.col("n_name").alias("name"))
    return relations.longest_name(texts, names)


DIVISIONS = [(1, 10, "small"), (11, 25, "middle"), (26, 40, "large")]


@query(f"""with r as (select * from (values {', '.join(str(x) for x in DIVISIONS)}) as t(lo, hi, division))
select p_partkey, p_size, division from part left join r on p_size between lo and hi""")
def division_range_join(spark, d):
    ranges = spark.createDataFrame(DIVISIONS, "lo int, hi int, division string")
    return relations.range_lookup(table(spark, d, "part").select("p_partkey", "p_size"), ranges, "p_size")


@query("""select p.event_id, p.user_id, v.event_id as last_view from (select * from events where event_type = 'purchase') p
  asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_view(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    return relations.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view").select("event_id", "user_id", "last_view")


# Citations of segments made from the documents themselves: every fifth quotes rightly, the others fail in a known way.
CLAIMS = f"""{SEG}, u as (select doc_id, ordinal, source || ':' || doc_id || '@l' || line_no as urn, content from s),
c as (select doc_id || '/' || ordinal as claim_id, doc_id, ordinal, content, urn as right_urn,
  case ordinal % 5 when 1 then 'no address' when 2 then urn || '9999' else urn end as urn,
  case ordinal % 5 when 3 then '' when 4 then left(content, 20) || '#' else left(content, 30) end as quote from u)"""


def _claims(spark, d):
    s = segments.addressed(segments.segment_lines(table(spark, d, "documents"), ("source",)))
    k = F.col("ordinal") % 5
    claim = s.select(
        F.concat_ws("/", "doc_id", "ordinal").alias("claim_id"), "doc_id", F.when(k == 1, "no address").when(k == 2, F.concat("urn", F.lit("9999"))).otherwise(F.col("urn")).alias("urn"),
        F.when(k == 3, "").when(k == 4, F.concat(F.substring("content", 1, 20), F.lit("#"))).otherwise(F.substring("content", 1, 30)).alias("quote"),
    )
    return s, claim


VERDICT = r"""case when not regexp_full_match(c.urn, '[a-z]+\d*:\d+@l\d+(?:-l\d+)?') then 'bad_urn' when h.content is null then 'not_found' when trim(quote) = '' then 'existence_only'
  when contains(h.content, trim(quote)) then 'ok' else 'quote_mismatch' end"""


@query(f"with {CLAIMS} select claim_id, c.urn, {VERDICT} as verdict from c left join u h on c.urn = h.urn")
def verify_quotes(spark, d):
    s, claim = _claims(spark, d)
    return evidence.verify(claim, s)


@query(f"""with {CLAIMS}, v as (select c.doc_id, {VERDICT} as verdict from c left join u h on c.urn = h.urn),
g as (select doc_id, count(*) as checked, count(*) filter (where verdict not in ('ok', 'existence_only')) as failed, count(*) filter (where verdict = 'existence_only') as existence_only from v group by doc_id)
select *, case when failed > 0 then 'failed' when existence_only = checked then 'existence_only' else 'verified' end as status from g""")
def report_status(spark, d):
    s, claim = _claims(spark, d)
    checked = evidence.verify(claim, s).join(claim.select("claim_id", "doc_id"), "claim_id")
    return evidence.report_status(checked, "doc_id")


STRIP = r"regexp_replace({}, '[\p{{P}}\p{{S}}\p{{Z}}\s]+', '', 'g')"
FOLD = "translate({}, 'éèóáàíúüß', 'eeoaaiuus')"


@query(f"""with {SEG}, n as (select *, concat_ws('', lag(content) over w, content, lead(content) over w) as wide, lead(content) over w as ahead from s window w as (partition by doc_id order by ordinal)),
q as (select doc_id || '/' || ordinal as claim_id, doc_id, ordinal, content, wide, case ordinal % 6 when 0 then '...' when 1 then replace(left(content, 40), ' ', '. ') when 2 then {FOLD.format('left(content, 40)')}
  when 3 then right(content, 10) || left(coalesce(ahead, ''), 10) when 4 then coalesce(ahead, '-') else 'zzzz' || content end as quote from n)
select claim_id, case when {STRIP.format('quote')} = '' then 'empty' when contains({STRIP.format('content')}, {STRIP.format('quote')}) then 'punctuation' when contains({FOLD.format('content')}, {FOLD.format('quote')}) then 'variant'
  when contains(wide, quote) then 'boundary' when exists (select 1 from s o where o.doc_id = q.doc_id and contains(o.content, quote)) then 'elsewhere' else 'absent' end as reason from q""")
def diagnose_quotes(spark, d):
    from folium.functions.text import fold

    s = segments.segment_lines(table(spark, d, "documents"))
    ahead = F.lead("content").over(W.partitionBy("doc_id").orderBy("ordinal"))
    k, c = F.col("ordinal") % 6, F.col("content")
    quote = (
        F.when(k == 0, "...").when(k == 1, F.replace(F.substring(c, 1, 40), F.lit(" "), F.lit(". "))).when(k == 2, fold(F.substring(c, 1, 40)))
        .when(k == 3, F.concat(F.right(c, F.lit(10)), F.substring(F.coalesce("ahead", F.lit("")), 1, 10))).when(k == 4, F.coalesce("ahead", F.lit("-"))).otherwise(F.concat(F.lit("zzzz"), c))
    )
    failed = s.withColumn("ahead", ahead).select(F.concat_ws("/", "doc_id", "ordinal").alias("claim_id"), "doc_id", "ordinal", quote.alias("quote"))
    return evidence.diagnose(failed, s)


@query(r"""with c as (select conv_id, turn, 'see src' || turn || ':' || conv_id || '@l1-l' || (turn + 1) || ', and src' || turn || ':' || conv_id || '@l1-l' || (turn + 1) || ' or x:3@l4. ' || text as t from conversations)
select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[a-z]+\d*:\d+@l\d+(?:-l\d+)?'))), ' ') as citations from c""")
def extract_citations(spark, d):
    at = F.concat(F.lit("src"), F.col("turn").cast("string"), F.lit(":"), F.col("conv_id").cast("string"), F.lit("@l1-l"), (F.col("turn") + 1).cast("string"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("see "), at, F.lit(", and "), at, F.lit(" or x:3@l4. "), F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(evidence.extract(F.col("t"))), " ").alias("citations"))


@query("""with e as (select l_orderkey as doc_id, l_linenumber::bigint as owner, l_partkey % 200 as a, l_partkey % 200 + l_quantity::bigint as b from lineitem)
select distinct x.doc_id, x.owner from e x join e y on x.doc_id = y.doc_id and x.owner <> y.owner and x.a < y.b and y.a < x.b""")
def interval_conflicts(spark, d):
    a = F.col("l_partkey") % 200
    edits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("owner"), a.alias("start"), (a + F.col("l_quantity").cast("long")).alias("end"))
    return evidence.conflicts(edits)


TIERS = ["MACHINERY", "HOUSEHOLD", "BUILDING"]


@query(f"""with t as (select c_nationkey::bigint as anchor, c_name as hand, c_mktsegment as tier, list_position({TIERS}, c_mktsegment) as spot from customer),
r as (select *, row_number() over (partition by anchor order by coalesce(spot, 0), hand) as place, count(*) over (partition by anchor) - 1 as alternatives from t) select anchor, hand, tier, alternatives from r where place = 1""")
def rendering_select(spark, d):
    pool = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("anchor"), F.col("c_name").alias("hand"), F.col("c_mktsegment").alias("tier"))
    return renderings.select_rendering(pool, TIERS)


@query("""with a as (select conv_id as text_id, turn as ordinal from conversations), p as (select conv_id as text_id, turn as ordinal, 'p' || turn as rendering from conversations where role = 'assistant'),
g as (select distinct conv_id as text_id, 1::bigint as first, 3::bigint as last, 'r1-3' as rendering from conversations union all select distinct conv_id, 0, 9, 'r0-9' from conversations where conv_id % 2 = 0),
u as (select a.*, rendering, 0 as how, 0 as width from a join p using (text_id, ordinal) union all select a.*, rendering, 1, last - first from a join g using (text_id) where ordinal between first and last),
r as (select *, row_number() over (partition by text_id, ordinal order by how, width, rendering) as k from u) select text_id, ordinal, rendering, case how when 0 then 'exact' else 'covering' end as how from r where k = 1""")
def rendering_covering(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("text_id"), F.col("turn").alias("ordinal"), "role")
    points = c.where("role = 'assistant'").select("text_id", "ordinal", F.concat(F.lit("p"), F.col("ordinal").cast("string")).alias("rendering"))
    texts = c.select("text_id").distinct()
    span = lambda rows, a, b: rows.select("text_id", F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last"), F.lit(f"r{a}-{b}").alias("rendering"))
    return renderings.exact_or_covering(c.drop("role"), points, span(texts, 1, 3).union(span(texts.where("text_id % 2 = 0"), 0, 9)))


@query("""select role, count(distinct conv_id) as anchors, round(count(distinct conv_id) / (select count(distinct conv_id) from conversations)::double, 3) as coverage from conversations group by role""")
def rendering_coverage(spark, d):
    c = table(spark, d, "conversations")
    every = c.agg(F.count_distinct("conv_id").alias("every"))
    return c.groupBy("role").agg(F.count_distinct("conv_id").alias("anchors")).crossJoin(every).select("role", "anchors", F.round(F.col("anchors") / F.col("every"), 3).alias("coverage"))


@query("""select p_name as term, count(distinct p_type) as renderings, count(*) as entries, string_agg(distinct p_type, ',' order by p_type) as list from part group by p_name having count(distinct p_type) >= 2""")
def translators_divergent(spark, d):
    return renderings.divergent(table(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("rendering")))


@query(f"""with t as (select (lang <> 'en')::int as hand, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from (select lang, {TOKENS.format('text')} as w from documents where lang in ('en', 'de'))), c as (select hand, term, count(*) as n from t group by 1, 2),
s as (select *, 10000.0::double * n / sum(n) over (partition by hand) as rate from c), a as (select * from s where hand = 0 and n >= 12), b as (select * from s where hand = 1)
select a.term, a.n, coalesce(b.n, 0) as other, round(a.rate, 6) as rate, round(coalesce(b.rate, 0), 6) as other_rate, round(a.rate / greatest(coalesce(b.rate, 0), 0.05), 6) as skew from a left join b using (term)""")
def ngram_skew(spark, d):
    t = table(spark, d, "documents").where("lang in ('en', 'de')").select((F.col("lang") != "en").cast("int").alias("hand"), words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    t = t.where(F.size("w") >= 2).select("hand", F.explode(pairs).alias("term"))
    return renderings.skew(t.groupBy("hand", "term").agg(F.count("*").alias("n")))


@query("""with c as (select p_name as term, p_type as rendering, count(*) as n from part group by 1, 2) select term, rendering, n from c qualify row_number() over (partition by term order by n desc, length(rendering), rendering) = 1""")
def glossary_pins(spark, d):
    return renderings.pins(table(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("rendering")))


READINGS = {"ing": "ING", "the": "THE", "th": "TH", "tion": "TION", "e": "E", "ción": "CION"}


@query(f"""with r as (select doc_id, regexp_extract_all(coalesce(text, ''), '(?s)' || '{"|".join(sorted(READINGS, key=len, reverse=True))}' || '|.') as w, map({list(READINGS)}, {list(READINGS.values())}) as m from documents)
select doc_id, len(list_filter(w, lambda x: m[x] is not null))::bigint as known, len(list_filter(w, lambda x: m[x] is null))::bigint as unknown, coalesce(array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), ''), '') as reading from r""")
def readings_longest_match(spark, d):
    return renderings.longest_match(table(spark, d, "documents").select("doc_id", "text"), READINGS)


@query()
def wylie_transliterate(spark, d):
    return renderings.transliterate(table(spark, d, "documents").select("doc_id", F.concat(F.lit("བོད་ཡིག་ "), "text").alias("text")))


def _digest_sql(name: str, key: str, columns: list[str]) -> str:
    cell = " || chr(31) || ".join(f"coalesce('=' || {c}::varchar, '~')" for c in (key, *columns))
    return f"""select '{name}' as name, sum(n)::bigint as n, sha256(string_agg(h, '' order by bucket)) as digest from (
  select left(h, 2) as bucket, count(*) as n, sha256(string_agg(h, '' order by h)) as h from (select sha256({cell}) as h from {name}) group by 1)"""


@query(f"{_digest_sql('documents', 'doc_id', ['text', 'lang', 'source'])} union all {_digest_sql('benchmark', 'item_id', ['text'])}")
def release_digest(spark, d):
    a = identity.set_digest(table(spark, d, "documents"), "doc_id", ["text", "lang", "source"]).withColumn("name", F.lit("documents"))
    return a.unionByName(identity.set_digest(table(spark, d, "benchmark"), "item_id", ["text"]).withColumn("name", F.lit("benchmark")))


@query("""select doc_id, case when doc_id % 11 = 0 then 'removed' else 'changed' end as change from documents where doc_id % 11 = 0 or doc_id % 7 = 0
  union all select doc_id + 1000000000, 'added' from documents where doc_id % 13 = 0""")
def drift_check(spark, d):
    before = table(spark, d, "documents").select("doc_id", "text")
    after = before.where("doc_id % 11 <> 0").withColumn("text", F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = before.where("doc_id % 13 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return identity.drift(before, after.union(added), "doc_id", ["text"])


@query("select doc_id, lang from documents order by md5('folium' || doc_id), doc_id limit 50")
def seeded_sample(spark, d):
    return identity.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50, "folium")


@query(f"""with {SEG}, g as (select doc_id, ordinal, content, left(content, 29) || case when right(left(content, 30), 1) = 'x' then 'y' else 'x' end as altered from s where length(content) >= 30)
select lang, count(*) as cases, count(*) filter (where not contains(g.content, altered)) as rejected, count(*) filter (where contains(g.content, left(g.content, 30))) as accepted from g join documents using (doc_id) group by lang""")
def gold_alteration(spark, d):
    """A quote with one character altered must fail where the quote itself holds."""
    s = segments.segment_lines(table(spark, d, "documents"), ("lang",)).where(F.length("content") >= 30)
    altered = F.concat(F.substring("content", 1, 29), F.when(F.substring("content", 30, 1) == "x", "y").otherwise("x"))
    return s.groupBy("lang").agg(F.count("*").alias("cases"), F.sum((~F.contains("content", altered)).cast("int")).cast("long").alias("rejected"), F.sum(F.contains("content", F.substring("content", 1, 30)).cast("int")).cast("long").alias("accepted"))


OUTCOMES = """o as (select l_returnflag as type, l_linestatus as topic, l_quantity > 10 as hit, l_linenumber as rank, case when l_discount = 0 then 'stale' when l_tax = 0 then 'error' else 'ok' end as state, l_shipdate from lineitem),
k as (select type, topic, count(*) as cases, count(*) filter (where state = 'ok') as counted, count(*) filter (where state = 'ok' and hit) as hits, round(avg(rank) filter (where state = 'ok' and hit), 2) as mean_rank from o group by 1, 2)"""


def _outcomes(spark, d):
    state = F.when(F.col("l_discount") == 0, "stale").when(F.col("l_tax") == 0, "error").otherwise("ok")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("topic"), (F.col("l_quantity") > 10).alias("hit"), F.col("l_linenumber").alias("rank"), state.alias("state"))


@query(f"with {OUTCOMES} select *, case when counted > 0 then round(100.0 * hits / counted, 1) end as rate from k")
def scorecard(spark, d):
    return identity.scorecard(_outcomes(spark, d), ["type", "topic"])


@query(f"""with {OUTCOMES}, b as (select type, topic, hits + case when type = 'A' then 5 when type = 'N' then 1 else -3 end as was from k where topic = 'F' or type <> 'R')
select coalesce(k.type, b.type) as type, coalesce(k.topic, b.topic) as topic, hits as now, was, case when was is null then 'new' when hits is null then 'gone' when hits < was - 1 then 'regressed' when hits > was then 'improved' else 'held' end as verdict
from k full join b on k.type = b.type and k.topic = b.topic""")
def gate_compare(spark, d):
    now = identity.scorecard(_outcomes(spark, d), ["type", "topic"])
    was = now.where("topic = 'F' or type <> 'R'").withColumn("hits", F.col("hits") + F.expr("case when type = 'A' then 5 when type = 'N' then 1 else -3 end"))
    return identity.gate(now, was, ["type", "topic"])


@query(f"with {OUTCOMES}, g as (select unnest([1, 3, 5, 7]) as k_max) select k_max::bigint as k_max, type, count(*) as cases, count(*) filter (where hit and rank <= k_max) as hits from o, g where state = 'ok' group by 1, 2")
def sweep_grid(spark, d):
    """One pass over the outcomes for all parameter values: a row is counted once a value, beside its case."""
    grid = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 3, 5, 7)]))
    rows = _outcomes(spark, d).where("state = 'ok'").select("type", "hit", "rank", grid.alias("k_max"))
    return rows.groupBy("k_max", "type").agg(F.count("*").alias("cases"), F.sum((F.col("hit") & (F.col("rank") <= F.col("k_max"))).cast("int")).cast("long").alias("hits"))


@query("""with e as (select vec_id as case_id, label from embeddings where vec_id % 50 = 0),
h as (select a.vec_id as case_id, b.label, row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select e.case_id, min(rank) as rank from e join h on e.case_id = h.case_id and e.label = h.label and rank <= 5 group by 1)
select e.case_id, rank is not null as hit, rank from e left join r using (case_id)""")
def recall_probe(spark, d):
    from folium.operators import semantic

    v = table(spark, d, "embeddings")
    probes = v.where("vec_id % 50 = 0")
    found = semantic.knn(v, probes.select(F.col("vec_id").alias("query_id"), "embedding"), 6).where("query_id <> vec_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    found = found.select(F.col("query_id").alias("case_id"), F.col("label").alias("key"), place.cast("long").alias("rank"))
    return identity.hit_at_k(found, probes.select(F.col("vec_id").alias("case_id"), F.col("label").alias("key")), 5)


@query("""with c as (select 'shipped_in_order' as name, l_shipdate >= o_orderdate as agrees from lineitem join orders on l_orderkey = o_orderkey union all select 'toxic_is_low_quality', (toxic = 1) = (quality = 0) from labels),
g as (select name, count(*) filter (where agrees) as agreed, count(*) as total from c group by name)
select name as "check", agreed, total, round(agreed / total::double, 6) as rate, case when total < 20 then 'too_few' when round(agreed / total::double, 6) >= 0.6 then 'pass' else 'fail' end as status from g""")
def coherence_rates(spark, d):
    shipped = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("shipped_in_order").alias("check"), (F.col("l_shipdate") >= F.col("o_orderdate")).alias("agrees"))
    marked = table(spark, d, "labels").select(F.lit("toxic_is_low_quality").alias("check"), ((F.col("toxic") == 1) == (F.col("quality") == 0)).alias("agrees"))
    return identity.agreement(shipped.union(marked), 0.6, 20)


@query("""select case when source in ('src1', 'src2') then 'forbidden' when lang = 'en' then 'servable' else 'withheld' end as class, count(*) as documents, sum(n_chars)::bigint as chars from documents group by 1""")
def publishing_audit(spark, d):
    kind = F.when(F.col("source").isin("src1", "src2"), "forbidden").when(F.col("lang") == "en", "servable").otherwise("withheld")
    return table(spark, d, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query(f"""with a as ({_digest_sql('documents', 'doc_id', ['text'])}), b as ({_digest_sql('benchmark', 'item_id', ['text'])})
select 'quotations' as kind, (select digest from a) as input_digest, (select digest from b) as output_digest, (select n from b) as rows, 'complete' as status""")
def derivation_receipt(spark, d):
    """What a derivation read and wrote, from the log: it is run at first, and not again over the same input."""
    folder = f"{shared_folder(spark)}/receipts-{uuid.uuid4().hex}"
    source = receipts.Watched(table(spark, d, "documents"), "doc_id", ("text",))
    output = receipts.Watched(table(spark, d, "benchmark"), "item_id", ("text",))
    for _ in range(2):
        receipts.derive(folder, "quotations", "1", source, lambda: (output, output.rows.count(), 0))
    return receipts.log(spark, folder).select(F.col("derivation").alias("kind"), "input_digest", "output_digest", F.col("output_rows").alias("rows"), "status")
