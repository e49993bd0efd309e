"""Readers on files' rows made from the test tables, with SQL that states what the files say."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.plans.registry import query
from folium.sources import markup, tables
from folium.sources.tables import table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""select 'W' || o_custkey as work, o_orderkey || '.' || o_shippriority || '.2' as locator, o_orderstatus || ' text' as text, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ordinal from orders""".replace("o_shippriority", "1"))
def segment_json_rows(spark, d):
    """Objects of addressed segments, in the natural order of their numbers."""
    o = table(spark, d, "orders")
    entry = F.struct(_text("W", F.col("o_custkey"), ":", F.col("o_orderkey"), ".1.2").alias("k"), _text(F.col("o_orderstatus"), " text").alias("v"))
    files = o.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return tables.segment_json(files).select("work", "locator", "text", F.col("ordinal").cast("long").alias("ordinal"))


@query("""select p_brand as file, p_mfgr as category, p_name as term, p_type as rendering, case when p_size % 4 = 0 then 'not ' || p_size else '' end as rejected, p_partkey as line_no from part""".replace("p_mfgr", "'C' || (p_partkey // 10)"))
def glossary_tables(spark, d):
    """Pipe tables under headings, a heading for every ten entries."""
    p = table(spark, d, "part")
    no, of = F.col("p_partkey"), F.expr("p_partkey div 10")
    head = p.groupBy("p_brand", of.alias("c")).agg(F.min(no).alias("at")).select(F.col("p_brand").alias("file"), (F.col("at") * 2 - 1).alias("line_no"), _text("## C", F.col("c")).alias("value"))
    body = p.select(F.col("p_brand").alias("file"), (no * 2).alias("line_no"), _text("| ", F.col("p_name"), " | ", F.when(F.col("p_size") % 4 == 0, _text('**not** "not ', F.col("p_size"), '", ')).otherwise(""), F.col("p_type"), " |").alias("value"))
    rows = tables.glossary_markdown(head.unionByName(body))
    return rows.select("file", "category", "term", "rendering", F.array_join("rejected", ",").alias("rejected"), (F.col("line_no") / 2).cast("long").alias("line_no"))


@query("""select c_name as traditional, 'S' || c_custkey as simplified, lower(c_mktsegment) as reading, c_nationkey || ',' || 'sense b' as senses from customer where c_custkey % 9 <> 0""")
def cedict_entries(spark, d):
    """Dictionary lines; comments and malformed ones are left out."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    line = F.when(key % 9 == 0, _text("# ", key)).otherwise(_text(F.replace("c_name", F.lit(" "), F.lit("_")), " S", key, " [", F.col("c_mktsegment"), "] /", F.col("c_nationkey"), "/sense b/"))
    rows = markup.cedict(c.select(line.alias("value")))
    return rows.select("traditional", "simplified", "reading", F.array_join("senses", ",").alias("senses"))


@query("""select 'T' as canon, 'T' || lpad((p_partkey % 70)::varchar, 4, '0') as work, string_agg(distinct (p_size % 9)::varchar, ',' order by (p_size % 9)::varchar) as volumes, count(distinct p_size % 9) as files from part group by p_partkey % 70""")
def work_list_files(spark, d):
    """Works and their volumes from file names."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 70).alias("w"), (F.col("p_size") % 9).alias("v")).distinct()
    volume = F.lpad(F.col("v").cast("string"), 2, "0")
    paths = p.select(_text("T/T", volume, "/T", volume, "n", F.lpad(F.col("w").cast("string"), 4, "0"), ".xml").alias("path"))
    other = spark.createDataFrame([("readme.md",), ("T/notes.txt",)], "path string")
    rows = markup.work_list(paths.union(other))
    return rows.select("canon", "work", F.array_join(F.transform("volumes", lambda v: v.cast("string")), ",").alias("volumes"), F.size("paths").cast("long").alias("files"))


@query("""select 'v' || n_nationkey as volume, 'page ' || k as label, n_name || '_' || k || '.jpg' as file from nation, range(1, 4) t(k)""")
def iiif_canvases(spark, d):
    """Page images of manifests."""
    k = F.explode(F.sequence(F.lit(1), F.lit(3)))
    pages = table(spark, d, "nation").select("n_nationkey", "n_name", k.alias("k"))
    canvas = F.struct(_text("page ", F.col("k")).alias("label"), F.array(F.struct(F.struct(_text("http://host/iiif/", F.col("n_name"), "_", F.col("k"), ".jpg").alias("@id")).alias("resource"))).alias("images"))
    whole = pages.groupBy("n_nationkey").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(canvas).alias("canvases"))).alias("sequences"))).alias("json"))
    return markup.canvases(whole.select(_text("v", F.col("n_nationkey")).alias("volume"), "json"))


@query("""with x as (select s_suppkey, 'f' || s_suppkey as path, md5(s_name) as sha from supplier), f as (select path, case when s_suppkey % 7 = 1 then 'other' else sha end as sha256 from x where s_suppkey % 5 <> 0), l as (select path, sha as sha256 from x where s_suppkey % 3 <> 0)
select coalesce(f.path, l.path) as path, case when f.path is null then 'missing' when l.path is null then 'unexpected' else 'changed' end as problem from f full join l on f.path = l.path where f.sha256 is distinct from l.sha256""")
def lock_check(spark, d):
    """Files against a lock: missing, unexpected, changed."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(k, _text("f", k).alias("path"), F.md5(F.col("s_name").cast("binary")).alias("sha"))
    found = x.where(k % 5 != 0).select("path", F.when(k % 7 == 1, "other").otherwise(F.col("sha")).alias("sha256"))
    return tables.lock_mismatches(found, x.where(k % 3 != 0).select("path", F.col("sha").alias("sha256")))


@query("""select s_suppkey as volume, s_suppkey * 3 + k as line_no, 'D' || s_suppkey as work, k || 'a' || case when k = 2 then '' else '' end as anchor, 'line ' || k || ' of ' || s_name as text from supplier, range(1, 4) t(k)""".replace("k || 'a' || case when k = 2 then '' else '' end", "case when k = 1 then '1a' when k = 2 then '1b' else '1b+1' end"))
def anchored_lines(spark, d):
    """Lines with anchors under a work's mark; a repeated anchor gets a suffix."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    anchor = F.when(F.col("k") == 1, "1a").otherwise("1b")
    value = _text("[", anchor, "] ", F.when(F.col("k") == 1, _text("{D", F.col("s_suppkey"), "}")).otherwise(""), "line ", F.col("k"), " of ", F.col("s_name"))
    rows = s.select(F.col("s_suppkey").alias("volume"), (F.col("s_suppkey") * 3 + F.col("k")).alias("line_no"), value.alias("value"))
    return tables.anchored_text(rows).select("volume", "line_no", "work", "anchor", "text")


@query("""with t as (select p_partkey as doc_id, 'né ' || p_name || ' "' || p_type || '" (src' || p_size || ':' || p_partkey || '@l1-l2), then src1:' || p_partkey || '@l7] end' as text, 'src' || p_size || ':' || p_partkey || '@l1-l2' as a, 'src1:' || p_partkey || '@l7' as b from part)
select doc_id, a as urn, strlen(p_name || p_type) + 9::bigint as byte_start, strlen(p_name || p_type || a) + 9::bigint as byte_end, p_type as quoted, strlen(p_name) + 6::bigint as quote_start, strlen(p_name || p_type) + 6::bigint as quote_end, true as wrapped, false as unpaired from t join part on doc_id = p_partkey
union all select doc_id, b, strlen(p_name || p_type || a) + 17, strlen(p_name || p_type || a || b) + 17, null, null, null, false, true from t join part on doc_id = p_partkey""")
def citation_occurrences(spark, d):
    """Places in bytes of citations, with quotations and brackets; the SQL counts them from the parts."""
    from folium.operators import evidence

    k, size = F.col("p_partkey"), F.col("p_size")
    text = _text("né ", F.col("p_name"), ' "', F.col("p_type"), '" (src', size, ":", k, "@l1-l2), then src1:", k, "@l7] end")
    return evidence.occurrences(table(spark, d, "part").select(k.alias("doc_id"), text.alias("text")))


@query("""with f as (select l_orderkey as doc_id, l_linenumber * 10 as start, l_linenumber * 10 + 4 as "end", case when l_quantity > 20 then 'u' end as urn from lineitem), q as (select o_orderkey as doc_id, o_custkey % 50 as quote_start, o_custkey % 50 + 25 as quote_end from orders)
select doc_id, start, case when exists (select 1 from q where q.doc_id = f.doc_id and f.start >= quote_start and f."end" <= quote_end) then 'literal' when urn is null then 'unresolved' else 'unchecked' end as role from f""")
def foreign_evidence_roles(spark, d):
    from folium.operators import evidence

    at = F.col("l_linenumber") * 10
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), at.alias("start"), (at + 4).alias("end"), F.when(F.col("l_quantity") > 20, "u").alias("urn"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 50).alias("quote_start"), (F.col("o_custkey") % 50 + 25).alias("quote_end"))
    return evidence.evidence_roles(f, q)


@query("""with r as (select 'src:' || p_partkey || '@l1' as anchor, case when p_size % 2 = 0 then 'en' else 'de' end as lang, 'hand' || p_size % 5 as translator, p_type as text from part), a as (select 'src:' || p_partkey || '@l1#en.hand' || p_size % 5 as address, 'src:' || p_partkey || '@l1' as anchor, 'en' as lang, 'hand' || p_size % 5 as translator from part)
select address, text, text is not null as found, false as citable_as_source from a left join r using (anchor, lang, translator)""")
def rendering_addresses(spark, d):
    from folium.operators import renderings

    p = table(spark, d, "part")
    anchor, hand = _text("src:", F.col("p_partkey"), "@l1"), _text("hand", F.col("p_size") % 5)
    rows = p.select(anchor.alias("anchor"), F.when(F.col("p_size") % 2 == 0, "en").otherwise("de").alias("lang"), hand.alias("translator"), F.col("p_type").alias("text"))
    return renderings.addressed_renderings(p.select(F.concat(anchor, F.lit("#en."), hand).alias("address")), rows)


@query("""with l as (select 'w' || l_suppkey % 80 as work, case when l_suppkey % 80 = 7 and l_linenumber = 3 then 'other' else 'T' end as canon, l_linenumber::bigint as volume, l_orderkey as line_no, l_partkey % 6 as juan from lineitem)
select work, volume, row_number() over (partition by work order by volume, line_no) - 1 as ordinal, (select count(distinct juan) from l m where m.work = l.work) as n_juan from l where work not in (select work from l group by work having count(distinct canon) > 1)""")
def volumes_joined(spark, d):
    work = _text("w", F.col("l_suppkey") % 80)
    canon = F.when((F.col("l_suppkey") % 80 == 7) & (F.col("l_linenumber") == 3), "other").otherwise("T")
    lines = table(spark, d, "lineitem").select(work.alias("work"), canon.alias("canon"), F.col("l_linenumber").cast("long").alias("volume"), F.col("l_orderkey").alias("line_no"), (F.col("l_partkey") % 6).alias("juan"))
    return tables.volumes_joined(lines)


@query("""select n_name, 'b1' as bake_id, 'r1' as release_id from nation""")
def identity_columns(spark, d):
    from folium.operators import identity

    return identity.stamped(table(spark, d, "nation").select("n_name"), bake_id="b1", release_id="r1")


@query("""select case when o_custkey % 5 = 0 then 'undated' when o_custkey % 7 = 0 then 'without basis' else year(o_orderdate)::varchar end as dated, count(*) as works, count(*) filter (where o_custkey % 3 = 0) as placed from orders group by 1""")
def coverage_dated(spark, d):
    """How many works are dated, and with what ground."""
    k = F.col("o_custkey")
    dated = F.when(k % 5 == 0, "undated").when(k % 7 == 0, "without basis").otherwise(F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").groupBy(dated.alias("dated")).agg(F.count("*").alias("works"), F.count_if(k % 3 == 0).alias("placed"))


@query("""select coalesce(lang, '-') as lang, count(*) as texts, count(*) filter (where not exists (select 1 from embeddings where vec_id = doc_id)) as stranded, count(*) filter (where not exists (select 1 from labels l where l.doc_id = d.doc_id)) as unlabelled from documents d group by 1""")
def coverage_stranded(spark, d):
    """Texts that no vector, and no label, was made for."""
    docs, v, lab = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    rows = docs.join(v, "doc_id", "left").join(lab, "doc_id", "left")
    return rows.groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("texts"), F.count_if(F.col("v").isNull()).alias("stranded"), F.count_if(F.col("l").isNull()).alias("unlabelled"))
