"""JSON, event windows, roll-ups and set operations on the star schema: a superset of what the domain needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.plans.registry import query
from folium.sources.tables import table
from folium.streaming import events as stream


@query("select event_type, sum(json_extract(props, '$.k')::bigint)::bigint as k_sum, count(*) as n, max(json_extract(props, '$.k')::bigint) as k_max from events group by event_type")
def events_json_rollup(spark, d):
    k = F.expr("variant_get(parse_json(props), '$.k', 'bigint')")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("n"), F.max("k").alias("k_max"))


@query("select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, d):
    return stream.tumbling(table(spark, d, "events")).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with e as (select event_type, time_bucket(interval '1 hour', ts) as h from events), s as (select event_type, h as w from e union all select event_type, h - interval '1 hour' from e)
select event_type, strftime(w, '%Y-%m-%d %H:%M') as start, count(*) as n from s group by 1, 2""")
def events_sliding(spark, d):
    return stream.sliding(table(spark, d, "events")).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""with e as (select user_id, ts, case when ts >= lag(ts) over w + interval '30 minutes' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""")
def events_sessions(spark, d):
    return stream.sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, grouping(l_returnflag)::bigint * 2 + grouping(l_linestatus)::bigint as level, count(*) as n, round(sum(l_quantity), 2) as quantity
from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_rollup(spark, d):
    rows = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "level", "n", "quantity")


@query("""with a as (select o_custkey as k from orders where o_orderstatus = 'F'), b as (select o_custkey as k from orders where o_orderpriority = '1-URGENT')
select 'intersect' as op, count(*) as n, sum(k)::bigint as k_sum from (select k from a intersect select k from b) union all select 'except', count(*), sum(k)::bigint from (select k from a except select k from b)
union all select 'union', count(*), sum(k)::bigint from (select k from a union select k from b) union all select 'except_all', count(*), sum(k)::bigint from (select k from a except all select k from b)""")
def set_ops(spark, d):
    o = table(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    out = None
    for name, rows in (("intersect", a.intersect(b)), ("except", a.subtract(b)), ("union", a.union(b).distinct()), ("except_all", a.exceptAll(b))):
        one = rows.agg(F.count("*").alias("n"), F.sum("k").alias("k_sum")).select(F.lit(name).alias("op"), "n", "k_sum")
        out = one if out is None else out.union(one)
    return out


@query("""select c_mktsegment, count(*) filter (where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')) as having_open, count(*) filter (where not exists (select 1 from orders where o_custkey = c_custkey)) as without_orders from customer group by 1""")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    some = c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_semi").select("c_mktsegment", F.lit(1).alias("a"), F.lit(0).alias("b"))
    none = c.join(o, "c_custkey", "left_anti").select("c_mktsegment", F.lit(0).alias("a"), F.lit(1).alias("b"))
    zero = c.select("c_mktsegment").distinct().select("c_mktsegment", F.lit(0).alias("a"), F.lit(0).alias("b"))
    return some.union(none).union(zero).groupBy("c_mktsegment").agg(F.sum("a").alias("having_open"), F.sum("b").alias("without_orders"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= date '2001-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
