"""Placed passages, repairs and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions.text import VARIANTS
from folium.operators import anchoring, segments
from folium.plans.corpus import SEG
from folium.plans.registry import query
from folium.sources.tables import table

_SRC = "".join(c for g in VARIANTS for c in g[1:])
_DST = "".join(g[0] for g in VARIANTS for _ in g[1:])


def _form(x: str) -> str:
    return rf"translate(regexp_replace({x}, '[\p{{P}}\p{{S}}\p{{Z}}\s]+', '', 'g'), '{_SRC}', '{_DST}')"


_NUMERAL = "translate((ordinal // 4 % 30 + 1)::varchar, '0123456789', '〇一二三四五六七八九')"


@query(rf"""with recursive {SEG},
l as (select doc_id as work, ordinal, case when ordinal % 4 = 0 and ordinal // 4 % 7 <> 3 then '（' || {_NUMERAL} || '）' || content else content end as content from s),
n as (select doc_id as work, ordinal // 4 + 1 as number, content, lead(content) over (partition by doc_id order by ordinal) as c1, lead(content, 2) over (partition by doc_id order by ordinal) as c2, ordinal from s),
ps as (select work, number, unnest([{{'n': 1, 't': left(content, 20)}}, {{'n': 2, 't': 'qqxx'}}, {{'n': 3, 't': c2 || '!!'}}, {{'n': 4, 't': 'zzxx'}}, {{'n': 5, 't': left(c1, 15)}}, {{'n': 6, 't': '...'}}]) as p from n where ordinal % 4 = 0 and ordinal < 120),
pa as (select work, number, list({{'n': p.n, 'f': {_form('p.t')}}} order by p.n) as ps from ps where coalesce({_form('p.t')}, '') <> '' group by all),
pc as (select work, ordinal, unnest(range(1, len(x) + 1)) as i, unnest(x) as raw from (select work, ordinal, string_split(replace(content, '（', chr(1) || '（'), chr(1)) as x from l)),
pm as (select *, regexp_extract(raw, '^（([〇一二三四五六七八九]+)）', 1) as numeral, {_form('raw')} as form from pc),
pw as (select *, sum((numeral <> '')::int) over (partition by work order by ordinal, i) as win, from pm),
wi as (select work, win, max(numeral) as numeral, string_agg(form, '' order by ordinal, i) as h, list({{'a': ordinal, 'k': length(form)}} order by ordinal, i) as rows from pw where win > 0 group by work, win),
wc as (select *, count(*) over (partition by work, numeral) as printed from wi),
a as (select pa.*, translate(number::varchar, '0123456789', '〇一二三四五六七八九') as numeral from pa),
j as (select a.work, number, ps, h, rows from a join wc using (work, numeral) where printed = 1),
r as (
  select work, number, 0 as i, 0::bigint as cur, []::bigint[] as f from j
  union all
  select work, number, i + 1, case when p > 0 then cur + p - 1 + length(g) else cur end, list_append(f, case when p > 0 then cur + p - 1 end) from (
    select r.*, ps[i + 1].f as g, strpos(substring(h, cur::int + 1), ps[i + 1].f) as p from r join j using (work, number) where i < len(ps))),
e as (select work, number, ps, h, rows, f, unnest(range(1, len(ps) + 1)) as i from r join j using (work, number) where r.i = len(ps)),
b as (select *, ps[i].n as n, f[i] as here,
    coalesce(list_min(list_filter(f[i + 1:], lambda x: x is not null)), length(h)) as ahead,
    coalesce(list_max(list_transform(list_filter(range(1, i), lambda k: f[k] is not null), lambda k: f[k] + length(ps[k].f))), 0) as behind from e),
c as (select *, case when here is not null then 'exact' when ahead > behind then 'interpolated' else 'dropped' end as method from b),
d as (select *, case method when 'exact' then here when 'interpolated' then behind end as s, case method when 'exact' then here + length(ps[i].f) when 'interpolated' then ahead end as t from c),
o as (select *, list_transform(range(1, len(rows) + 1), lambda k: coalesce(list_sum(list_transform(rows[1:k - 1], lambda x: x.k)), 0)) as st from d)
select work, number, n::bigint as n, method, s::bigint as start, t::bigint as "end",
  rows[len(list_filter(st, lambda x: x <= s))].a::bigint as first_ordinal, rows[len(list_filter(st, lambda x: x <= greatest(s, t - 1)))].a::bigint as last_ordinal from o
union all
select work, number, p.n::bigint, case when c is null then 'no_marker' else 'ambiguous_marker' end, null, null, null, null
from (select a.work, number, unnest(ps) as p, c from a left join (select work, numeral, max(printed) as c from wc group by all) using (work, numeral) where c is null or c > 1)""")
def sequential_anchors(spark, d):
    """Passages of numbered windows: the window's own lines, repeated and reordered ones, and some that it doesn't hold. Every seventh marker is
    missing, and long texts print numbers twice."""
    from pyspark.sql import Window as W

    s = segments.segment_lines(table(spark, d, "documents"))
    number = (F.col("ordinal") / 4).cast("long")
    marker = F.concat(F.lit("（"), anchoring.numeral(number % 30 + 1), F.lit("）"))
    lines = s.select(F.col("doc_id").alias("work"), "ordinal", F.when((F.col("ordinal") % 4 == 0) & (number % 7 != 3), F.concat(marker, "content")).otherwise(F.col("content")).alias("content"))
    w = W.partitionBy("doc_id").orderBy("ordinal")
    near = s.withColumn("c1", F.lead("content").over(w)).withColumn("c2", F.lead("content", 2).over(w)).where("ordinal % 4 = 0 and ordinal < 120")
    texts = [F.substring("content", 1, 20), F.lit("qqxx"), F.concat("c2", F.lit("!!")), F.lit("zzxx"), F.substring("c1", 1, 15), F.lit("...")]
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("n"), t.alias("text")) for i, t in enumerate(texts)]))
    passages = near.select(F.col("doc_id").alias("work"), (number + 1).alias("number"), each.alias("p")).select("work", "number", "p.*")
    return anchoring.sequential_anchors(passages, lines)


_BARE = r"regexp_replace({}, '[\p{{P}}\p{{S}}\p{{Z}}\s]+', '', 'g')"


@query(rf"""with {SEG},
q as (select doc_id, ordinal, content, ordinal % 6 as k, case ordinal % 6 when 0 then replace(left(content, 60), '"', '') when 1 then 'zzzz qqqq ' || replace(left(content, 60), '"', '') when 2 then replace(replace(left(content, 60), '"', ''), ' ', '. ') else 'as it says' end as quote,
  'src:' || doc_id || '@' || case ordinal % 6 when 4 then 'l99999' when 5 then 'none' else 'l' || ordinal end as urn from s),
t as (select *, 'It says ' || case when k = 3 then '' else '"' || quote || '" ' end || '[' || urn || '].' as text, {_BARE.format('quote')} as needle, {_BARE.format('content')} as line from q),
c as (select *, len(list_filter(range(1, length(line) + 1), lambda i: needle <> '' and substring(line, i, length(needle)) = needle)) as n from t),
v as (select *, case when k in (4, 5) then 'no_sources' when k = 3 or quote = '' then 'existence_only' when trim(quote) <> '' and contains(content, trim(quote)) then 'verified' when needle = '' then 'flagged' when n = 1 then 'quote_relaxed' when n > 1 then 'flagged' else 'no_sources' end as state from c)
select doc_id, ordinal, state, case when k = 4 then 'not_found' when k = 5 then 'bad_urn' when state in ('existence_only', 'verified') then null when needle = '' then 'empty_quote' when n = 1 then 'editorial_punctuation' when n > 1 then 'ambiguous_quote' else 'not_found_in_search' end as reason,
  case when state <> 'quote_relaxed' then sha256(case when state = 'no_sources' then replace(text, '[' || urn || ']', '') else text end) end as text_sha256 from v""")
def citations_repaired(spark, d):
    """A text for each segment: its own words, its words with other marks, words that it doesn't have, no quotation, no such line, no
    address."""
    from folium.operators import repairing

    s = segments.segment_lines(table(spark, d, "documents"))
    k, urn = F.col("ordinal") % 6, F.concat(F.lit("src:"), F.col("doc_id").cast("string"), F.lit("@l"), F.col("ordinal").cast("string"))
    held = s.select(urn.alias("urn"), "doc_id", "ordinal", "content")
    own = F.replace(F.substring("content", 1, 60), F.lit('"'), F.lit(""))
    quote = F.when(k == 0, own).when(k == 1, F.concat(F.lit("zzzz qqqq "), own)).when(k == 2, F.replace(own, F.lit(" "), F.lit(". "))).otherwise(F.lit("as it says"))
    cited = F.concat(F.lit("src:"), F.col("doc_id").cast("string"), F.lit("@"), F.when(k == 4, F.lit("l99999")).when(k == 5, F.lit("none")).otherwise(F.concat(F.lit("l"), F.col("ordinal").cast("string"))))
    text = F.concat(F.lit("It says "), F.when(k == 3, F.lit("")).otherwise(F.concat(F.lit('"'), quote, F.lit('" '))), F.lit("["), cited, F.lit("]."))
    done = repairing.repair(s.select(F.struct("doc_id", "ordinal").alias("doc_id"), text.alias("text")), held)
    action = F.get("actions", F.lit(0))
    return done.select("doc_id.doc_id", "doc_id.ordinal", action["state"].alias("state"), action["reason"].alias("reason"), F.when(action["state"] != "quote_relaxed", F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"))


@query(f"""with {SEG}, r as (select doc_id, row_number() over (partition by doc_id order by ordinal) as i, ordinal % 6 as k, content from s)
select doc_id, (4 * i - 2)::bigint as line,
  case when k >= 4 or i > 25 then 'refused' when k = 2 then 'changed' when k = 1 then 'failed' when k = 3 then 'executed' else 'verified' end as status,
  case k when 4 then 'unknown_question' when 5 then 'invalid_json' else case when i > 25 then 'too_many_records' end end as problem from r""")
def report_replays(spark, d):
    """A report for each document, with a record for each line: right and wrong assertions, none, another corpus, an unknown question, no JSON."""
    from folium.operators import reports

    s = segments.segment_lines(table(spark, d, "documents"))
    urn = F.concat(F.lit("src:"), F.col("doc_id").cast("string"), F.lit("@l"), F.col("ordinal").cast("string"))
    k, quoted = F.col("ordinal") % 6, lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    facts = F.when(k == 1, quoted(', "assert": {"length": ', (F.length("content") + 1).cast("string"), "}")).when(k == 3, F.lit("")).otherwise(quoted(', "assert": {"sha256": "', F.col("content_sha256"), '", "length": ', F.length("content").cast("string"), "}"))
    body = quoted('{"question": "', F.when(k == 4, F.lit("drop")).otherwise(F.lit("line")), '", "arguments": {"urn": "', urn, '"}', F.when(k == 2, F.lit(', "corpus": "old"')).otherwise(F.lit("")), facts, F.when(k == 5, F.lit("")).otherwise(F.lit("}")))
    block = quoted("prose\n```replay\n", body, "\n```")
    texts = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", block.alias("b")))).alias("bs")).select("doc_id", F.array_join(F.transform("bs", lambda b: b["b"]), "\n").alias("text"))
    held = s.select(urn.alias("urn"), "doc_id", "content")
    return reports.replayed(reports.records(texts), {"line": reports.line_question(held), "phrase": reports.phrase_question(held)}, "now")
