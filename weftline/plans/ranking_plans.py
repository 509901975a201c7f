"""Queries over rankings: metrics, votes and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import metrics as M
from weftline.operators import rank as K
from weftline.plans.registry import query
from weftline.plans.retrieval_plans import _DENSE, dense_hits
from weftline.session import table

# Predictions: labels of the ten nearest vectors in order (with repeats); gold: the own label and the one after it.
_BASE = f"""with {_DENSE},
p as (select query_id, rank as pos, e.label as item from dense join e on doc_id = e.vec_id),
g as (select vec_id as query_id, label % 10 as item from e where vec_id % 50 = 0 union select vec_id, (label + 1) % 10 from e where vec_id % 50 = 0),
h as (select *, item in (select item from g where g.query_id = p.query_id) as hit, row_number() over (partition by query_id, item order by pos) = 1 as fresh from p),
q as (select query_id, count(*) as n from g group by query_id)"""


def _judged(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = dense_hits(spark, sf_dir).join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    pred = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("pred"))
    gold = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.array(F.col("label") % 10, (F.col("label") + 1) % 10).alias("gold"))
    return M.with_predictions(gold, pred)


def _metric(name, spark, sf_dir, k, value):
    return _judged(spark, sf_dir).select("query_id", F.round(value(F.col("pred"), F.col("gold"), k), 6).alias(name))


@query(f"{_BASE} select query_id, coalesce(max(case when hit and pos <= 3 then 1.0e0 else 0.0e0 end), 0) as acc from q left join h using (query_id) group by query_id")
def acc_hit_at_k(spark, sf_dir):
    """M01"""
    return _metric("acc", spark, sf_dir, 3, M.METRICS["acc"])


@query(f"{_BASE} select query_id, case when count(distinct case when hit and pos <= 5 then item end) = max(n) then 1.0e0 else 0.0e0 end as acc from q left join h using (query_id) group by query_id")
def acc_strict_at_k(spark, sf_dir):
    """M02"""
    return _metric("acc", spark, sf_dir, 5, M.METRICS["acc_strict"])


@query(f"{_BASE} select query_id, round(coalesce(1.0e0 / min(case when hit then pos end), 0), 6) as rr from q left join h using (query_id) group by query_id")
def mrr(spark, sf_dir):
    """M03"""
    return _metric("rr", spark, sf_dir, 10, M.METRICS["mrr"])


@query(f"{_BASE}, c as (select *, sum(case when hit and fresh then 1 else 0 end) over (partition by query_id order by pos) as hits from h) select query_id, round(coalesce(sum(case when hit and fresh then hits / pos end), 0) / max(n), 6) as ap from q left join c using (query_id) group by query_id")
def map_by_gold(spark, sf_dir):
    """M04"""
    return _metric("ap", spark, sf_dir, 10, M.METRICS["map_gold"])


@query(f"{_BASE}, c as (select *, sum(case when hit then 1 else 0 end) over (partition by query_id order by pos) as hits from h) select query_id, round(coalesce(sum(case when hit then hits / pos end), 0) / 10, 6) as ap from q left join c using (query_id) group by query_id")
def map_by_k(spark, sf_dir):
    """M05"""
    return _metric("ap", spark, sf_dir, 10, M.METRICS["map_k"])


@query(f"{_BASE}, c as (select *, sum(case when hit then 1 else 0 end) over (partition by query_id order by pos) as hits from h) select query_id, round(coalesce(sum(case when hit then hits / pos end), 0) / max(n), 6) as ap from q left join c using (query_id) group by query_id")
def map_dup_counted(spark, sf_dir):
    """M06"""
    return _metric("ap", spark, sf_dir, None, M.METRICS["map_repeats"])


@query(f"{_BASE} select query_id, round(coalesce(sum(case when hit and pos <= 5 then 1 / log2(pos + 1.0) end), 0) / (1 + 1 / log2(3.0)), 6) as ndcg from q left join h using (query_id) group by query_id")
def ndcg(spark, sf_dir):
    """M07"""
    return _metric("ndcg", spark, sf_dir, 5, M.METRICS["ndcg"])


@query(f"{_BASE} select query_id, round(coalesce(sum(case when hit and pos <= 5 then 1 end), 0) / 5.0e0, 6) as pre, round(coalesce(sum(case when hit and pos <= 5 then 1 end), 0) / 2.0e0, 6) as rec from q left join h using (query_id) group by query_id")
def precision_recall_at_k(spark, sf_dir):
    """M08"""
    j = _judged(spark, sf_dir)
    return j.select("query_id", F.round(M.precision_at(F.col("pred"), F.col("gold"), 5), 6).alias("pre"), F.round(M.recall_at(F.col("pred"), F.col("gold"), 5), 6).alias("rec"))


_SETS = f"""{_BASE},
sizes as (select query_id, max(n) as n, count(distinct case when hit and pos <= 8 then item end) as c, count(distinct case when pos <= 8 then item end) as d from q left join h using (query_id) group by query_id),
m as (select query_id, case when c = n then 1.0e0 else 0.0e0 end as sl, c / n as rec, case when d > 0 then c / d else 0 end as pre from sizes),
f as (select *, case when rec + pre > 0 then 2 * rec * pre / (rec + pre) else 0 end as f1 from m)"""


@query(f"{_SETS} select query_id, sl, round(rec, 6) as rec, round(pre, 6) as pre, round(f1, 6) as f1 from f")
def prf_set(spark, sf_dir):
    """M09"""
    j = _judged(spark, sf_dir)
    return j.select("query_id", *(F.round(v, 6).alias(k) for k, v in M.set_metrics(F.col("pred"), F.col("gold"), 8).items()))


@query(f"{_SETS} select count(*) as n, round(avg(sl), 6) as success, round(avg(pre), 6) as pre, round(avg(rec), 6) as rec, round(avg(f1), 6) as f1 from f where query_id in (select query_id from q)")
def success_loc(spark, sf_dir):
    """Over queries that have gold."""
    j = _judged(spark, sf_dir).where(F.size("gold") > 0)
    m = j.select(*(v.alias(k) for k, v in M.set_metrics(F.col("pred"), F.col("gold"), 8).items()))
    return m.agg(F.count("*").alias("n"), *(F.round(F.avg(a), 6).alias(b) for a, b in (("sl", "success"), ("pre", "pre"), ("rec", "rec"), ("f1", "f1"))))


@query(
    f"""{_BASE}, j as (select q.query_id, max(case when hit and pos = 1 then 1.0e0 else 0 end) as t1, max(case when hit and pos <= 3 then 1.0e0 else 0 end) as t3, coalesce(1.0e0 / min(case when hit and pos <= 5 then pos end), 0) as rr, max(case when pos is null then 1.0e0 else 0 end) as blank from q left join h using (query_id) group by q.query_id)
select round(100 * avg(t1), 2) as top1, round(100 * avg(t3), 2) as top3, round(100 * avg(rr), 2) as mrr, round(100 * avg(blank), 2) as empty_rate from j"""
)
def metric_rollup(spark, sf_dir):
    """M11, M12"""
    p, g = F.col("pred"), F.col("gold")
    return M.macro(_judged(spark, sf_dir), {"top1": M.acc(p, g, 1), "top3": M.acc(p, g, 3), "mrr": M.reciprocal_rank(p, g, 5), "empty_rate": (F.size(p) == 0).cast("double")})


_LISTS = "l as (select user_id, event_type as sample, array_agg(p order by ts, event_id) as items from (select *, cast(json_extract(props, '$.k') as bigint) as p from events) group by user_id, event_type)"


def _lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("sample"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("p"))
    return e.groupBy("user_id", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "p"))), lambda x: x["p"]).alias("items"))


def _vote_sql(weight):
    return f"""with {_LISTS}, e as (select user_id, sample, i as pos, items[i] as item from l, unnest(range(1, len(items) + 1)) as u(i)),
s as (select user_id, item, {weight} as weight, min(struct_pack(a := sample, b := pos)) as first from e group by user_id, item),
r as (select *, row_number() over (partition by user_id order by weight desc, first) as rank from s) select user_id, item, weight, rank from r"""


@query(_vote_sql("count(*)::double"))
def vote_majority(spark, sf_dir):
    """A user's items by how often they occur in the lists of its event types."""
    return K.vote(_lists(spark, sf_dir), "user_id", "sample", "items").withColumn("rank", F.col("rank").cast("long"))


@query(_vote_sql("round(sum(1.0e0 / pos), 6)"))
def vote_rr_sum(spark, sf_dir):
    """By sums of reciprocal places."""
    return K.vote(_lists(spark, sf_dir), "user_id", "sample", "items", "mrr").withColumn("rank", F.col("rank").cast("long"))


@query(
    """with p as (select l_orderkey as instance, l_linenumber as idx, case when l_quantity < 10 then '' else l_returnflag || l_linestatus end as key, l_suppkey % 3 as bad, l_partkey % 4 = 0 as ok from lineitem),
b as (select * from (select *, min(bad) over (partition by instance) as least from p) where bad = least and trim(key) <> ''),
s as (select * from (select *, max(ok) over (partition by instance) as any_ok from b) where not any_ok or ok),
c as (select instance, key, count(*) as votes, min(idx) as first from s group by instance, key)
select instance, arg_min(key, struct_pack(a := -votes, b := first, c := key)) as pick, max(votes) as votes from c group by instance"""
)
def vote_gated(spark, sf_dir):
    """Line items as patches of their order."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_quantity") < 10, "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("key"), (F.col("l_suppkey") % 3).alias("regression_failures"), (F.col("l_partkey") % 4 == 0).alias("reproduced"))
    return K.gated_vote(p)


@query("select l_orderkey, key, min(l_linenumber)::bigint as first, count(*) as n from (select *, l_returnflag || l_linestatus as key from lineitem) group by l_orderkey, key")
def dedupe_counts(spark, sf_dir):
    """Keys with their first index and count."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("key")).agg(F.min("l_linenumber").cast("long").alias("first"), F.count("*").alias("n"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def dedupe_first(spark, sf_dir):
    """A user's first event of every type."""
    e = K.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return e.select("user_id", "event_type", "event_id", "value")


@query("select user_id, event_id, rank from (select *, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 when 'click' then 2 else 9 end, value desc, event_id) as rank from events) where rank <= 5")
def priority_limit(spark, sf_dir):
    """A user's five first events by type priority, value and id."""
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(9)
    return K.priority_limit(table(spark, sf_dir, "events"), "user_id", [p, F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


_ROLE = "case when l_quantity > 25 then 'primary' else 'context' end"


@query(
    f"""with t as (select l_orderkey, l_linenumber, {_ROLE} as role, row_number() over w as rank, sum(case when {_ROLE} = 'primary' then 1 else 0 end) over w as seen from lineitem window w as (partition by l_orderkey order by l_extendedprice desc, l_linenumber))
select l_orderkey, l_linenumber::bigint as l_linenumber, case when role = 'primary' and seen > 2 then 'secondary' else role end as role, rank from t where rank <= 5"""
)
def capped_roles(spark, sf_dir):
    """Two primary lines and five lines an order at most."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr(_ROLE).alias("role"))
    found = K.capped_roles(t, "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")])
    return found.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("new_role").alias("role"), F.col("rank").cast("long").alias("rank"))


@query("with n as (select props as action, count(*) as n, max(case event_type when 'purchase' then 90 else 10 end) as p, min(event_id) as first from events group by props), v as (select *, greatest(n, p) as value from n) select action, value, row_number() over (order by value desc, first) as rank from v")
def promoted_queue(spark, sf_dir):
    """Actions by priority or frequency."""
    a = table(spark, sf_dir, "events").select(F.col("props").alias("action"), F.when(F.col("event_type") == "purchase", 90).otherwise(10).cast("long").alias("p"), "event_id")
    return K.promoted_order(a, "action", "p", "event_id").select("action", "value", F.col("rank").cast("long").alias("rank"))


@query("with f as (select o_custkey, o_orderkey, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end as p, o_orderpriority as format, o_orderstatus as query from orders) select o_custkey, arg_min(case when p < 3 then format else 'other' end, p) as format, string_agg(distinct query, ',' order by query) as queries from f group by o_custkey")
def best_format(spark, sf_dir):
    """A customer's most urgent format, and the states that found it."""
    f = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("o_orderpriority")).otherwise("other").alias("format"), F.col("o_orderstatus").alias("query"))
    found = K.best_format(f, "o_custkey", {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2})
    return found.select("o_custkey", "format", F.concat_ws(",", "queries").alias("queries"))


@query("with s as (select user_id, event_id as item, value as score from events where value > 75), r as (select *, row_number() over (partition by user_id order by score desc, item) as rank, count(*) over (partition by user_id) as n from s) select user_id, item, rank from r where rank <= case when n <= 3 then 1 else 3 end")
def threshold_top(spark, sf_dir):
    """A user's best events above 75."""
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("item"), F.col("value").alias("score"))
    return K.threshold_or_first(s, "user_id", "score").select("user_id", "item", F.col("rank").cast("long").alias("rank"))
