"""Vector search, fusion, reranking, hybrid search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folium.functions.text import query_words, words
from folium.operators import finding, lexical, segments, semantic
from folium.plans.corpus import SEG, TOKENS, _hits_sql
from folium.plans.registry import query
from folium.sources.tables import table

DOT = "round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9)"


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _asked(spark, d, where):
    return _vectors(spark, d).where(where).select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_sql(where: str, k: int) -> str:
    return f"""h as (select a.vec_id as query_id, b.vec_id, b.label, {DOT} as similarity from embeddings a, embeddings b where a.{where}),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from h qualify rank <= {k})"""


@query(f"with {_knn_sql('vec_id = 0', 10)} select vec_id, label, similarity, rank from r")
def knn_exact(spark, d):
    return semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id = 0"), 10).drop("query_id")


@query(f"with {_knn_sql('vec_id % 50 = 0', 5)} select query_id, vec_id, label, similarity, rank from r")
def knn_batch(spark, d):
    return semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id % 50 = 0"), 5)


@query(f"""with {_knn_sql('vec_id % 50 = 0', 20)}, t as (select *, row_number() over (partition by query_id, label order by similarity desc, vec_id) as turn from r)
select query_id, vec_id, label, turn, row_number() over (partition by query_id order by turn, similarity desc, label) as place from t""")
def knn_label_balanced(spark, d):
    hits = semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id % 50 = 0"), 20)
    return semantic.balanced(hits, "label").select("query_id", "vec_id", "label", "turn", "place")


@query(f"""with {_knn_sql('vec_id % 50 = 0', 11)}, q as (select vec_id as query_id, label as own from embeddings)
select own as label, count(*) as hits_seen, sum((own = label)::bigint)::bigint as agreeing, round(avg((own = label)::int), 6) as rate from r join q using (query_id) where query_id <> vec_id group by own""")
def knn_hit_at_k(spark, d):
    hits = semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id % 50 = 0"), 11).where("query_id <> vec_id")
    own = _vectors(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    same = (F.col("own") == F.col("label")).cast("int")
    return hits.join(own, "query_id").groupBy(F.col("own").alias("label")).agg(F.count("*").alias("hits_seen"), F.sum(same).cast("long").alias("agreeing"), F.round(F.avg(same), 6).alias("rate"))


@query(f"""with {_knn_sql('vec_id % 50 = 0', 20)}, g as (select *, vec_id // 3 as chunk, case when vec_id % 3 = 0 then 'source' else 'translation' end as arm from r)
select query_id, chunk, max(similarity) as similarity, string_agg(distinct arm, ',' order by arm) as arms from g group by query_id, chunk""")
def collapse_multivector(spark, d):
    hits = semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id % 50 = 0"), 20)
    hits = hits.withColumn("chunk", F.expr("vec_id div 3")).withColumn("arm", F.when(F.expr("vec_id % 3 = 0"), "source").otherwise("translation"))
    return semantic.collapse(hits, "chunk", "arm")


@query(f"""with {_knn_sql('vec_id % 50 = 0', 11)}, b as (select query_id, max(similarity) as best from r where query_id <> vec_id group by query_id)
select case when best >= 0.75 then 'strong' when best >= 0.7 then 'weak' else 'no_close_match' end as band, count(*) as queries from b group by 1""")
def confidence_band(spark, d):
    hits = semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id % 50 = 0"), 11).where("query_id <> vec_id")
    return hits.groupBy("query_id").agg(F.max("similarity").alias("best")).groupBy(semantic.confidence(F.col("best")).alias("band")).agg(F.count("*").alias("queries"))


ARMS = {"phrase": "the thing", "words": "the thing and an ing"}


@query(f"""with {SEG}, p as ({_hits_sql([ARMS['phrase']], 's', 60)}), w as ({_hits_sql(query_words(ARMS['words']), 's', 60)}),
a as (select doc_id, ordinal, rank from p union all select doc_id, ordinal, rank from w),
f as (select doc_id, ordinal, round(sum(1.0::double / (60 + rank)), 9) as rrf_score from a group by all)
select doc_id, ordinal, rrf_score, row_number() over (order by rrf_score desc, doc_id, ordinal) as rank from f""")
def rrf_fuse(spark, d):
    s = segments.segment_lines(finding.holding(table(spark, d, "documents"), [ARMS["phrase"], *query_words(ARMS["words"])]))
    arm = lambda hits, name: hits.select(F.lit(0).alias("query_id"), F.lit(name).alias("arm"), F.struct("doc_id", "ordinal").alias("place"), "rank")
    arms = arm(lexical.phrase_search(s, ARMS["phrase"], 60), "phrase").union(arm(lexical.word_search(s, ARMS["words"], 60), "words"))
    return semantic.rrf(arms, "place").select("place.*", "rrf_score", "rank")


@query(f"""with u as (select conv_id, turn, {TOKENS.format('text')} as q from conversations where role = 'user'),
a as (select conv_id, turn - 1 as turn, {TOKENS.format('text')} as w from conversations where role = 'assistant'),
j as (select conv_id, u.turn, case when len(q) = 0 then 0.0::double else round(len(list_intersect(list_distinct(q), list_distinct(w))) / len(list_distinct(q))::double, 6) end as containment from u join a using (conv_id, turn))
select conv_id, turn, containment, row_number() over (partition by conv_id order by containment desc, turn) as new_rank from j""")
def rerank_containment(spark, d):
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").select(F.col("conv_id").alias("query_id"), "turn", words(F.col("text")).alias("query_words"))
    given = c.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), (F.col("turn") - 1).alias("turn"), words(F.col("text")).alias("text_words"))
    hits = asked.join(given, ["query_id", "turn"]).withColumn("rank", F.col("turn"))
    return semantic.rerank(hits, "turn").select(F.col("query_id").alias("conv_id"), "turn", "containment", "new_rank")


@query(f"""with {SEG}, p as ({_hits_sql([ARMS['phrase']], 's', 60)}), w as ({_hits_sql(query_words(ARMS['words']), 's', 60)}),
{_knn_sql('vec_id = 0', 60)},
a as (select doc_id, min(rank) as rank from p group by doc_id union all select doc_id, min(rank) from w group by doc_id union all select vec_id, rank from r),
f as (select doc_id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score from a group by doc_id),
k as (select *, row_number() over (order by rrf_score desc, doc_id) as rank from f qualify rank <= 50),
c as (select k.*, round(len(list_intersect(['the', 'thing', 'and', 'an', 'ing'], list_distinct({TOKENS.format('text')}))) / 5.0::double, 6) as containment from k join documents using (doc_id))
select doc_id, rrf_score, rank as fused_rank, containment, row_number() over (order by containment desc, rank) as rank from c order by rank limit 10""")
def hybrid_search(spark, d):
    """Phrase, word and vector arms, fused, then the 50 best reranked by containment of the query's words."""
    docs = table(spark, d, "documents")
    s = segments.segment_lines(finding.holding(docs, [ARMS["phrase"], *query_words(ARMS["words"])]))
    per_doc = lambda hits: hits.groupBy("doc_id").agg(F.min("rank").alias("rank"))
    vector = semantic.knn(_vectors(spark, d), _asked(spark, d, "vec_id = 0"), 60).select(F.col("vec_id").alias("doc_id"), "rank")
    arms = per_doc(lexical.phrase_search(s, ARMS["phrase"], 60)).union(per_doc(lexical.word_search(s, ARMS["words"], 60))).union(vector)
    fused = semantic.rrf(arms.withColumn("query_id", F.lit(0)), "doc_id").where("rank <= 50")
    texts = docs.join(F.broadcast(fused), "doc_id")  # 50 rows at most
    asked = F.array(*[F.lit(w) for w in ARMS["words"].split()])
    scored = semantic.rerank(texts.withColumn("query_words", asked).withColumn("text_words", words(F.col("text"))), "doc_id")
    return scored.where("new_rank <= 10").select("doc_id", "rrf_score", F.col("rank").alias("fused_rank"), "containment", F.col("new_rank").alias("rank"))


@query("""with p as (select p_partkey, lower(p_name) as name, p_type from part), q as (select 0::bigint as query, 'all about ' || (select p_name from part where p_partkey = 1) || ' and ' || (select p_name from part where p_partkey = 2) as text),
m as (select distinct query, name from p, q where length(name) >= 8 and contains(lower(text), name)),
x as (select * from m where not exists (select 1 from m o where o.query = m.query and o.name <> m.name and contains(o.name, m.name))),
t as (select *, row_number() over (partition by query order by length(name) desc, name) as k from x)
select query, t.name as headword, string_agg(distinct p_type, ',' order by p_type) as terms from t join p using (name) where k <= 3 group by query, t.name""")
def glossary_expand(spark, d):
    """Headwords found in a query, only the longest of nested ones, three at most, with their terms."""
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_name", "p_type")
    named = p.where("p_partkey in (1, 2)").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    asked = named.select(F.lit(0).cast("long").alias("query"), F.concat(F.lit("all about "), F.array_join(F.transform("x", lambda x: x["p_name"]), " and ")).alias("text"))
    hit = p.where(F.length("name") >= 8).join(F.broadcast(asked), F.contains(F.lower("text"), F.col("name"))).select("query", "name").distinct()
    nested = hit.alias("m").join(hit.alias("o"), (F.col("m.query") == F.col("o.query")) & (F.col("m.name") != F.col("o.name")) & F.contains("o.name", "m.name"), "left_anti")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.length("name").desc(), "name"))
    chosen = nested.withColumn("k", place).where("k <= 3")
    return chosen.join(p, "name").groupBy("query", F.col("name").alias("headword")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("terms"))
