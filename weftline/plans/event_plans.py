"""Queries over the event log and the conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import events as E
from weftline.plans.registry import query
from weftline.session import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("select event_id, user_id from events where event_type in ('click', 'purchase') and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' and contains(props, '7')")
def event_filter(spark, sf_dir):
    """by types, times and a text in the payload."""
    found = E.matching(_events(spark, sf_dir), types=["click", "purchase"], start="2024-01-05", end="2024-01-20")
    return found.where(F.contains("props", F.lit("7"))).select("event_id", "user_id")


@query("select event_id, user_id, props from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' and event_id between 200 and 9000 and contains(lower(props), '\"k\": 7')")
def event_search(spark, sf_dir):
    """By inclusive times and ids, and a text of the payload in any case."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.col("props").alias("content"))
    found = E.matching(e.withColumn("content", F.replace("content", F.lit('"'), F.lit("'"))), "event_id", start="2024-01-05", end="2024-01-20", first=200, last=9000, text="'K': 7")
    return found.select("event_id", "user_id", F.replace("content", F.lit("'"), F.lit('"')).alias("props"))


@query(
    """with l as (select user_id, max(event_id) as last from events where event_type = 'click' group by user_id)
select user_id, coalesce(last, -1) + row_number() over (partition by user_id order by ts, event_id) as id, replace(event_type || ' token ' || event_id % 7, 'token', '<secret_hidden>') as content from events left join l using (user_id) where event_type <> 'click'"""
)
def event_append(spark, sf_dir):
    """All but clicks appended to each user's log of clicks, with following ids and without secrets."""
    e = _events(spark, sf_dir)
    log = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"))
    new = e.where("event_type <> 'click'").select("user_id", "ts", "event_id", F.concat(F.col("event_type"), F.lit(" token "), F.col("event_id") % 7).alias("content"))
    return E.append(log, new, "user_id", [F.col("ts"), F.col("event_id")], secrets=["token"]).select("user_id", "id", "content")


@query("select event_id, event_type, to_base64(encode((row_number() over (order by event_id) - 1)::varchar)) as token from events where event_type <> 'view' and event_id >= 100 order by event_id limit 50")
def event_page(spark, sf_dir):
    """A page of fifty with each row's token (a limit is the feature)."""
    p = E.page(E.matching(_events(spark, sf_dir), "event_id", without=["view"], first=100), 50, "event_id")
    return p.select("event_id", "event_type", E.page_token(F.row_number().over(Window.orderBy("event_id")) - 1).alias("token"))


@query("select max(event_id) + 1 as next_id from events")
def event_next_id(spark, sf_dir):
    """E02"""
    return E.next_id(_events(spark, sf_dir), "event_id")


@query(
    """with t as (select conv_id * 100 + turn as id, role, lag(conv_id * 100 + turn) over (partition by conv_id order by turn) as cause from conversations),
a as (select id from t where role = 'user'), o as (select cause, max(id) as id from t where role = 'assistant' group by cause)
select a.id as action_id, o.id as observation_id from a full join o on a.id = o.cause"""
)
def event_pairs(spark, sf_dir):
    """User turns and the assistant turns that answer them."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    t = c.select(key.alias("id"), "role", F.lag(key).over(Window.partitionBy("conv_id").orderBy("turn")).alias("cause"))
    return E.pairs(t.where("role = 'user'"), t.where("role = 'assistant'"))


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id, event_type")
def event_latest_by_source(spark, sf_dir):
    """E05"""
    return E.latest(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("select user_id, props, count(*) as n from events group by user_id, props")
def event_counts(spark, sf_dir):
    """E13"""
    return _events(spark, sf_dir).groupBy("user_id", "props").agg(F.count("*").alias("n"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as u, row_number() over (partition by conv_id order by turn desc) as d from conversations) where u <= 1 or d <= 2")
def retain_head_tail(spark, sf_dir):
    """W17"""
    return E.head_tail(_turns(spark, sf_dir), "conv_id", ["turn"], 1, 3).select("conv_id", "turn")


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as u, count(*) over (partition by conv_id) as n from conversations) where n <= 4 or u <= 1 or u > n - 1")
def retain_amortized(spark, sf_dir):
    """W17"""
    return E.amortized(_turns(spark, sf_dir), "conv_id", ["turn"], 1, 4).select("conv_id", "turn")


@query("select conv_id, turn, case when role = 'assistant' and n - u >= 3 then '<MASKED>' else md5(text) end as text from (select *, row_number() over (partition by conv_id order by turn) as u, count(*) over (partition by conv_id) as n from conversations)")
def mask_old(spark, sf_dir):
    """W18"""
    t = _turns(spark, sf_dir).withColumn("text", F.md5("text"))
    return E.mask_old(t, "conv_id", ["turn"], 3, F.col("role") == "assistant").select("conv_id", "turn", "text")


@query("select conv_id, turn, case when role = 'user' and k > 1 then '<MASKED>' else md5(text) end as text from (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn desc) as k from conversations)")
def mask_type_tail(spark, sf_dir):
    """W19"""
    t = _turns(spark, sf_dir).withColumn("text", F.md5("text"))
    return E.mask_type_tail(t, "conv_id", ["turn"], 1, F.col("role") == "user").select("conv_id", "turn", "text")


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by case when length(text) % 3 = 0 then 1 else 0 end desc, turn desc) as r from conversations) where r <= 3")
def attention_fill(spark, sf_dir):
    """W20"""
    return E.attention_fill(_turns(spark, sf_dir), "conv_id", ["turn"], F.length("text") % 3 == 0, 3).select("conv_id", "turn")


_LAST = "with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as d from events)"


@query(f"{_LAST} select user_id, count(*) = 4 and count(distinct event_type) = 1 as stuck from l where d <= 4 group by user_id")
def loop_same4(spark, sf_dir):
    """E08"""
    return E.same_last(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type"])


@query(
    """with a as (select user_id, event_type as v, row_number() over (partition by user_id order by ts desc, event_id desc) as d from events where event_type in ('click', 'view')),
o as (select user_id, event_type = 'error' as bad, row_number() over (partition by user_id order by ts desc, event_id desc) as d from events where event_type in ('error', 'purchase')),
x as (select user_id, count(*) = 4 as enough, count(distinct case when d <= 3 then v end) = 1 as same from a where d <= 4 group by user_id),
y as (select user_id, count(*) = 4 as seen, bool_and(bad) filter (d <= 3) as failing from o where d <= 4 group by user_id)
select user_id, enough and same and seen and failing as stuck from x join y using (user_id)"""
)
def loop_repeated_error(spark, sf_dir):
    """E09"""
    e = _events(spark, sf_dir)
    a = e.where("event_type in ('click', 'view')").select("user_id", "ts", "event_id", F.col("event_type").alias("value"))
    o = e.where("event_type in ('error', 'purchase')").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("is_error"))
    return E.repeated_error(a, o, "user_id", ["ts", "event_id"])


@query(
    """with h as (select *, count(case when event_type = 'purchase' then 1 end) over (partition by user_id order by ts, event_id) as heard from events),
s as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as d from h where event_type in ('click', 'view'))
select user_id, count(*) = 3 and count(distinct event_type) = 1 and max(heard) = min(heard) as stuck from s where d <= 3 group by user_id"""
)
def loop_monologue(spark, sf_dir):
    """E10"""
    kind = F.col("event_type")
    return E.monologue(_events(spark, sf_dir), "user_id", ["ts", "event_id"], kind.isin("click", "view"), kind == "purchase", "event_type")


@query(f"{_LAST} select user_id, count(*) = 4 and count(distinct case when d % 2 = 0 then event_type end) = 1 and count(distinct case when d % 2 = 1 then event_type end) = 1 as stuck from l where d <= 4 group by user_id")
def loop_alternate(spark, sf_dir):
    """E11"""
    return E.alternating(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", 4)


@query(
    """with p as (select *, row_number() over (partition by user_id order by ts, event_id) as p from events), c as (select *, lead(p) over (partition by user_id order by ts, event_id) as nx, row_number() over (partition by user_id order by ts desc, event_id desc) as d from p where event_type = 'error')
select user_id, coalesce(bool_or(nx = p + 1), false) as stuck from c where d <= 3 group by user_id"""
)
def loop_condensation(spark, sf_dir):
    """E12"""
    return E.adjacent_repeat(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("select event_id, coalesce(bool_and(value < 60) over w and count(*) over w = 4, false) as stop from events window w as (partition by user_id order by ts, event_id rows between 3 preceding and current row)")
def early_stop_window(spark, sf_dir):
    """W15"""
    return E.all_similar(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") < 60, 4).select("event_id", "stop")


@query("select event_id, coalesce(abs(value - lag(value) over (partition by user_id order by ts, event_id)) <= 3, false) as similar from events")
def lag_similar(spark, sf_dir):
    """W16"""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select("event_id", F.coalesce(F.abs(F.col("value") - before) <= 3, F.lit(False)).alias("similar"))
