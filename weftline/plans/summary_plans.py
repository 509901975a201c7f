"""Relational queries: joins, sets, rollups, descriptions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import summary as S
from weftline.plans.registry import query
from weftline.session import table


@query("select event_type, count(*) as n from events group by event_type")
def value_counts(spark, sf_dir):
    """A04, A08"""
    return S.most_common(table(spark, sf_dir, "events"), "event_type")


@query("select lang, source, count(*) as n, count(distinct text) as n_texts from documents group by lang, source")
def nested_counts(spark, sf_dir):
    """A05"""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


@query("select l_quantity::bigint as quantity, count(*) as n from lineitem group by 1")
def histogram(spark, sf_dir):
    """A06"""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("quantity")).agg(F.count("*").alias("n"))


@query("select user_id, coalesce(round(avg(case when event_type = 'purchase' then value end), 6), 0) as mean_purchase from events group by user_id")
def guarded_mean(spark, sf_dir):
    """A07"""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(S.guarded_mean(F.when(F.col("event_type") == "purchase", F.col("value")), 6).alias("mean_purchase"))


@query("select l_returnflag, l_linestatus, count(l_extendedprice) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std, min(l_extendedprice) as min, round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3, max(l_extendedprice) as max from lineitem group by all")
def describe_by_group(spark, sf_dir):
    """A09"""
    return S.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("with b as (select unnest([0, 1, 2, 3, 4]) as bin, unnest([0.0e0, 10, 50, 90, 100]) as above, unnest([10.0e0, 50, 90, 100, 1000]) as upto) select bin, above, upto, count(event_id) as n from b left join events on value > above and value <= upto group by all")
def bin_counts(spark, sf_dir):
    """A10"""
    return S.binned(table(spark, sf_dir, "events"), "value", [0, 10, 50, 90, 100, 1000])


@query("select distinct event_type, value, round(cume_dist() over (partition by event_type order by value), 6) as share from events")
def ecdf(spark, sf_dir):
    """A11"""
    return S.ecdf(table(spark, sf_dir, "events"), "event_type", "value")


@query("select o_orderstatus, o_orderpriority, count(*) as n, count(*) filter (o_totalprice > 200000) as hits, round(count(*) filter (o_totalprice > 200000) / count(*), 6) as rate from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_rates(spark, sf_dir):
    """A12"""
    return S.rollup_rates(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice") > 200000)


@query("select case when year(o_orderdate) < 1996 then '1995 Before' else year(o_orderdate)::varchar end as year, count(*) as n from orders group by 1")
def year_bucket(spark, sf_dir):
    """T29, A12"""
    return table(spark, sf_dir, "orders").groupBy(S.year_bucket(F.col("o_orderdate"), 1996).alias("year")).agg(F.count("*").alias("n"))


@query("select count(*) as total, count(*) filter (event_type = 'purchase') as resolved, round(100 * count(*) filter (event_type = 'purchase') / count(*), 2) as resolved_pct, count(*) filter (event_type = 'error') as error, round(100 * count(*) filter (event_type = 'error') / count(*), 2) as error_pct, round(avg(value), 4) as mean_value from events")
def run_summary(spark, sf_dir):
    """A13"""
    kind = F.col("event_type")
    return S.run_summary(table(spark, sf_dir, "events"), {"resolved": kind == "purchase", "error": kind == "error"}, {"mean_value": F.col("value")})


@query()
def bootstrap_ci(spark, sf_dir):
    """The share of good documents."""
    return S.bootstrap_interval(table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)


@query(
    """with x as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as p from (select *, case when l_orderkey % 3 = 0 then 5.0e0 else l_tax end as cost from lineitem)),
t as (select l_orderkey, p // 2 as pair, sum(cost) as s, count(*) as c, max(cost) - min(cost) < 1e-6 as same from x group by l_orderkey, p // 2)
select l_orderkey, round(sum(s), 6) as total, round(case when bool_and(same and c = 2) then sum(s) / 2 else sum(s) end, 6) as corrected from t group by l_orderkey"""
)
def cost_pairs_fix(spark, sf_dir):
    """A15"""
    x = table(spark, sf_dir, "lineitem").withColumn("cost", F.when(F.col("l_orderkey") % 3 == 0, 5.0).otherwise(F.col("l_tax")))
    return S.paired_costs(x, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "cost")


@query("select o_orderpriority as model, round(sum(l_quantity * 0.5e0 + l_linenumber * 2.0e0 * ascii(o_orderpriority)), 4) as cost from lineitem join orders on o_orderkey = l_orderkey group by 1")
def cost_dim(spark, sf_dir):
    """Quantities and line numbers priced by the order's priority."""
    o = table(spark, sf_dir, "orders")
    prices = o.select(F.col("o_orderpriority").alias("model")).distinct().select("model", F.lit(0.5).alias("p_in"), (2.0 * F.ascii("model")).alias("p_out"))
    usage = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("model"), F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("completion"))
    return S.token_cost(usage, prices).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("cost"))


_RULES = {"short": "n_chars < 500", "long": "n_chars > 5000", "foreign": "lang <> 'en'", "blank": "trim(text) = ''", "link": "regexp_matches(text, 'https?://')"}


@query("select reason, count(*) as n from (" + " union all ".join(f"select '{k}' as reason from documents where {v}" for k, v in _RULES.items()) + ") group by reason")
def reason_counts(spark, sf_dir):
    """A25, F15"""
    rules = {k: F.expr(v.replace("regexp_matches", "regexp_like")) for k, v in _RULES.items()}
    return S.reason_counts(table(spark, sf_dir, "documents"), S.exclusion_reasons(rules))


@query("select doc_id, concat_ws(',', " + ", ".join(f"case when {v} then '{k}' end" for k, v in _RULES.items()) + ") as reasons from documents")
def exclusion_tags(spark, sf_dir):
    """F15"""
    rules = {k: F.expr(v.replace("regexp_matches", "regexp_like")) for k, v in _RULES.items()}
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", S.exclusion_reasons(rules)).alias("reasons"))


_QUALITY = {"no_hash": r"not regexp_matches(text, '\b[0-9a-f]{40}\b')", "no_link": "not regexp_matches(text, 'https?://|www\\.')", "no_media": r"not regexp_matches(text, '(?i)\.(png|jpe?g|gif|mp4|svg)')", "no_issue": r"not regexp_matches(text, '(?i)(^|\s)#[0-9]+')", "few_words": "len(string_split_regex(trim(text), '\\s+')) <= 400"}


@query("select count(*) as \"all\", " + ", ".join(f"count(*) filter ({' and '.join(list(_QUALITY.values())[: i + 1])}) as {k}" for i, k in enumerate(_QUALITY)) + " from documents")
def quality_filters(spark, sf_dir):
    """survivors of a chain of text predicates."""
    t = F.col("text")
    steps = {"no_hash": ~t.rlike(r"\b[0-9a-f]{40}\b"), "no_link": ~t.rlike(r"https?://|www\."), "no_media": ~t.rlike(r"(?i)\.(png|jpe?g|gif|mp4|svg)"), "no_issue": ~t.rlike(r"(?i)(^|\s)#[0-9]+"), "few_words": F.size(F.split(F.trim(t), r"\s+")) <= 400}
    return S.filter_chain(table(spark, sf_dir, "documents"), steps)


@query("select o_orderkey, n between 1 and 4 and d between 1 and 3 as clean from (select l_orderkey as o_orderkey, count(*) as n, count(distinct l_suppkey) as d from lineitem group by 1)")
def clean_subset(spark, sf_dir):
    """orders with one to four lines of one to three suppliers."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("d"))
    return n.select("o_orderkey", (F.col("n").between(1, 4) & F.col("d").between(1, 3)).alias("clean"))


@query("with d as (select o_custkey, count(*) filter (o_orderstatus = 'F') - count(*) filter (o_orderstatus = 'O') as diff from orders group by 1) select o_custkey, diff, abs(diff) > greatest(3.0, 1.5 * (select avg(abs(diff)) from d)) as notable from d")
def repo_diff_threshold(spark, sf_dir):
    """A28"""
    s = F.col("o_orderstatus")
    return S.win_loss(table(spark, sf_dir, "orders"), "o_custkey", s == "F", s == "O")


@query("select user_id from events group by user_id, props having false union all (select distinct user_id * 1000 + length(props) as user_id from events where event_type = 'purchase' except select user_id * 1000 + length(props) from events where event_type in ('click', 'view'))")
def venn_exclusive(spark, sf_dir):
    """(user, payload length) keys of purchases that neither clicks nor views have."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.length("props")).alias("user_id"), "event_type")
    return S.exclusive(e, "user_id", "event_type", "purchase", ["click", "view"])


@query("select count(*) = 0 as same from ((select o_orderkey, o_custkey from orders except select l_orderkey, o_custkey from lineitem join orders on o_orderkey = l_orderkey) union all (select l_orderkey, o_custkey from lineitem join orders on o_orderkey = l_orderkey except select o_orderkey, o_custkey from orders))")
def resultset_equal(spark, sf_dir):
    """Whether orders with lines are all orders."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "o_custkey")
    return S.same_results(o.select("o_orderkey", "o_custkey"), lines)


@query("select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    """J04, J06"""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def anti_resume(spark, sf_dir):
    """J05, F20"""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select l.l_orderkey, l.l_partkey, count(r.l_orderkey) as n from (select l_orderkey, l_partkey from lineitem) l left join (select l_orderkey, l_partkey from lineitem where l_returnflag = 'R') r on l.l_orderkey = r.l_orderkey and l.l_partkey = r.l_partkey group by all")
def left_multikey(spark, sf_dir):
    """J02, J03"""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", F.lit(1).alias("hit"))
    return l.join(r, ["l_orderkey", "l_partkey"], "left").groupBy("l_orderkey", "l_partkey").agg(F.count("hit").alias("n"))


@query("select x.user_id, x.event_id as event_id_x, y.event_id as event_id_y from (select user_id, max(event_id) as event_id from events where event_type = 'click' group by 1) x join (select user_id, max(event_id) as event_id from events where event_type = 'view' group by 1) y using (user_id)")
def inner_compare(spark, sf_dir):
    """Two runs side by side, columns with suffixes."""
    run = lambda kind, s: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias(f"event_id_{s}"))
    return run("click", "x").join(run("view", "y"), "user_id")


@query("select key, kind, n from (select c_mktsegment as key, 'customer' as kind, count(*) as n from customer group by 1 union all select p_brand, 'part', count(*) from part group by 1)")
def union_all_align(spark, sf_dir):
    """U01, U04"""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("part"))
    return a.unionByName(b)


@query("with s as (select user_id, list_distinct(array_agg(event_type) filter (value > 50)) as a, list_distinct(array_agg(event_type) filter (value <= 50)) as b from events group by user_id) select user_id, len(list_intersect(a, b)) as both_n, len(list_distinct(list_concat(a, b))) as any_n, (select count(*) from unnest(a) as t(x) where not list_contains(b, x)) as only_n from s")
def set_algebra(spark, sf_dir):
    """U02"""
    kind, high = F.col("event_type"), F.col("value") > 50
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(high, kind)).alias("a"), F.collect_set(F.when(~high, kind)).alias("b"))
    n = lambda x: F.size(x).cast("long")
    return s.select("user_id", n(F.array_intersect("a", "b")).alias("both_n"), n(F.array_union("a", "b")).alias("any_n"), n(F.array_except("a", "b")).alias("only_n"))


_HUNKS = (" a\n-b\n+c\n d", "+x\n+y\n z\n-w", "-p\n-q\n+r\n s")
_TOUCHED = ((1, 2), (0, 1), (0, 1, 2))


@query(
    " union ".join(f"select l_orderkey as instance_id, 'src/f' || l_suppkey || '.py' as file, l_partkey + {at} as old_line from lineitem where l_linenumber % 3 = {k}" for k, lines in enumerate(_TOUCHED) for at in lines)
)
def diff_changed_lines(spark, sf_dir):
    """A patch an order, with a file and hunk of one of three shapes for each of its items."""
    from weftline.operators.diffs import changed_old_lines

    def hunk(x):  # made of what is collected, so that no texts move
        body = F.element_at(F.array(*(F.lit(h) for h in _HUNKS)), (x["l_linenumber"] % 3 + 1).cast("int"))
        file = F.concat(F.lit("src/f"), x["l_suppkey"], F.lit(".py"))
        return F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -"), x["l_partkey"], F.lit(",4 +"), x["l_partkey"], F.lit(",4 @@ def f\n"), body)

    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey")))
    patches = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id")).agg(items.alias("items")).select("instance_id", F.array_join(F.transform("items", hunk), "\n").alias("patch"))
    return changed_old_lines(patches).select("instance_id", "file", "old_line")


_SAID = ("PASSED t{t}", "FAILED t{t} - msg", "ERROR t{t}", "XFAIL t{t}", "noise t{t}")
_LINE = f"replace([{', '.join(f"'{x}'" for x in _SAID)}][1 + l_quantity::int % 5], '{{t}}', cast(l_partkey % 3 as varchar))"
_STATUSES = f"select l_orderkey as instance_id, 't' || l_partkey % 3 as test, arg_max(case l_quantity::int % 5 when 1 then 'FAILED' when 2 then 'ERROR' else 'PASSED' end, (l_linenumber, {_LINE})) as status from lineitem where l_quantity::int % 5 < 4 group by all"


def _logs(spark, sf_dir):
    """A log an order: a line for each of its items, in order."""
    said = F.element_at(F.array(*(F.lit(x) for x in _SAID)), (F.col("l_quantity").cast("int") % 5 + 1).cast("int"))
    line = F.replace(said, F.lit("{t}"), (F.col("l_partkey") % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("log"))


@query(_STATUSES)
def log_status_last(spark, sf_dir):
    """The last status of every test in the orders' logs."""
    from weftline.operators.diffs import test_statuses

    return test_statuses(_logs(spark, sf_dir)).select("instance_id", "test", "status")


@query(
    f"""with s as ({_STATUSES}),
gold as (select distinct l_orderkey as instance_id, 't' || l_partkey % 3 as test, case when l_partkey % 3 = 0 then 'p2p' else 'f2p' end as kind from lineitem union all select o_orderkey, 'gone', 'f2p' from orders where o_orderkey % 7 = 0),
r as (
  select instance_id, coalesce(avg(cast(coalesce(status = 'PASSED', false) as integer)) filter (kind = 'f2p'), 1.0e0) as f2p, coalesce(avg(cast(coalesce(status = 'PASSED', false) as integer)) filter (kind = 'p2p'), 1.0e0) as p2p
  from gold left join s using (instance_id, test) group by instance_id)
select instance_id, round(f2p, 6) as f2p, round(p2p, 6) as p2p, case when f2p = 1 and p2p = 1 then 'FULL' when f2p > 0 and f2p < 1 and p2p = 1 then 'PARTIAL' else 'NO' end as resolution from r"""
)
def resolution_status(spark, sf_dir):
    """The orders' logs graded against the tests that they should pass; some tests never ran."""
    from weftline.operators.diffs import resolution, test_statuses

    t = F.col("l_partkey") % 3
    gold = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.concat(F.lit("t"), t).alias("test"), F.when(t == 0, "p2p").otherwise("f2p").alias("kind")).distinct()
    gone = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("instance_id"), F.lit("gone").alias("test"), F.lit("f2p").alias("kind"))
    found = resolution(gold.unionByName(gone), test_statuses(_logs(spark, sf_dir)))
    return found.select("instance_id", F.round("f2p", 6).alias("f2p"), F.round("p2p", 6).alias("p2p"), "resolution")


_TESTS = "(select l_orderkey as instance_id, l_partkey as t, cast(max(l_quantity) as integer) % 4 as s from lineitem group by all)"
_RUN = {
    "unittest": """case s when 0 then 'test_' || t || ' (a.B) ... ok' when 1 then 'test_' || t || ' (a.B) ... FAIL' when 2 then 'test_' || t || ' (a.B) ... some output' || chr(10) || 'ok' else 'ERROR: test_' || t || ' (a.B)' end""",
    "maven": """'[INFO] Tests run: 5, Failures: ' || cast(s = 1 as integer) || ', Errors: ' || cast(s = 3 as integer) || ', Skipped: 0, Time elapsed: 0.1 s - in pkg.T' || t""",
    "jest": """case when s % 2 = 0 then 'PASS ' else 'FAIL ' end || 'src/t' || t || '.test.js (5 s)' || chr(10) || ' PASS not/at/start.js'""",
}


@query(
    "select instance_id, 'unittest' as grammar, 'test_' || t || ' (a.B)' as test, case s when 1 then 'FAILED' when 3 then 'ERROR' else 'PASSED' end as status from "
    + _TESTS
    + " union all select instance_id, 'maven', 'org.pkg.T' || t, case when s in (1, 3) then 'FAILED' else 'PASSED' end from "
    + _TESTS
    + " union all select instance_id, 'jest', 'src/t' || t || '.test.js', case when s % 2 = 0 then 'PASSED' else 'FAILED' end from "
    + _TESTS
)
def log_grammars(spark, sf_dir):
    """Logs of three frameworks made of every order's items."""
    from weftline.operators.diffs import test_statuses

    tests = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id"), F.col("l_partkey").alias("t")).agg((F.max("l_quantity").cast("int") % 4).alias("s"))
    out = None
    for grammar, line in _RUN.items():
        lines = tests.select("instance_id", "t", F.expr(line.replace("chr(10)", "char(10)").replace("cast(s = 1 as integer)", "int(s = 1)").replace("cast(s = 3 as integer)", "int(s = 3)")).alias("line"))
        logs = lines.groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "line"))), lambda x: x["line"]), "\n").alias("log"))
        own = test_statuses(logs, grammar=grammar).select("instance_id", F.lit(grammar).alias("grammar"), "test", "status")
        out = own if out is None else out.unionByName(own)
    return out
