"""Queries of Python calls resolved by scope, imports and packages, over modules made of the parts and of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import names as N
from weftline.plans.registry import query
from weftline.session import table

_FILE = "'k' || {0}_size || case when {0}_partkey % 6 = 0 then '/d' || {0}_partkey || '/__init__.py' else '/m' || {0}_partkey || '.py' end"
_C, _FN = "'c' || {0} % 5", "'f' || {0} % 7"
_NAMES = "case l_suppkey % 5 when 0 then 'c' || l_quantity::int % 5 when 1 then 'r' || l_quantity::int % 3 when 2 then 'f' || l_quantity::int % 7 when 3 then 'i' || l_quantity::int % 4 else 'x' || l_quantity::int % 10 end"
_FACTS = f"""with recursive p as (select p_partkey as k, {_FILE.format('p')} as file from part),
nodes as (
  select file, {_C.format('k')} as name, 'class' as kind from p union all select file, {_C.format('k')} || '.r' || k % 3, 'function' from p
  union all select file, {_FN.format('k')}, 'function' from p union all select file, {_FN.format('k')} || '.i' || k % 4, 'function' from p),
used as (
  select distinct file, case l_linenumber % 4 when 0 then {_C.format('k')} when 1 then {_C.format('k')} || '.r' || k % 3 when 2 then {_FN.format('k')} else {_FN.format('k')} || '.i' || k % 4 end as owner,
    case when l_linenumber % 4 = 0 then 'inherits' else 'invokes' end as kind, {_NAMES} as name from lineitem join p on k = l_partkey),
n as (select count(*) as n, min(p_partkey) as first from part),
targets as (
  select distinct s.file, t.file || case l_suppkey % 3 when 0 then '' when 1 then ':' || {_C.format('t.k')} else ':' || {_FN.format('t.k')} end as dst, case when l_quantity::int % 4 = 0 then 'x' || l_suppkey % 10 end as alias
  from lineitem join p s on s.k = l_partkey, n, p t where l_linenumber = 1 and t.k = first + (l_orderkey * 7 + l_suppkey) % n)"""


def facts(spark, sf_dir):
    """nodes, names used, and what imports mean: a module a part, imports and calls as lines of orders have them."""
    part = table(spark, sf_dir, "part")
    k, n, first = F.col("k"), part.count(), part.agg(F.min("p_partkey")).first()[0]
    of = lambda letter, m, c="k": F.concat(F.lit(letter), (F.col(c) % m).cast("string"))
    tail = F.when(k % 6 == 0, F.concat(F.lit("/d"), k, F.lit("/__init__.py"))).otherwise(F.concat(F.lit("/m"), k, F.lit(".py")))
    p = part.select(F.col("p_partkey").alias("k"), "p_size").select("k", F.concat(F.lit("k"), "p_size", tail).alias("file"))
    inner = [(of("c", 5), "class"), (F.concat_ws(".", of("c", 5), of("r", 3)), "function"), (of("f", 7), "function"), (F.concat_ws(".", of("f", 7), of("i", 4)), "function")]
    nodes = p.select("file", F.inline(F.array(*(F.struct(a.alias("name"), F.lit(b).alias("kind")) for a, b in inner))))
    l = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    at = F.col("l_linenumber") % 4
    owner = F.when(at == 0, inner[0][0]).when(at == 1, inner[1][0]).when(at == 2, inner[2][0]).otherwise(inner[3][0])
    kinds = [of("c", 5, "q"), of("r", 3, "q"), of("f", 7, "q"), of("i", 4, "q"), of("x", 10, "q")]
    name = F.element_at(F.array(*kinds), (F.col("l_suppkey") % 5 + 1).cast("int"))
    lines = l.join(p, F.col("l_partkey") == k)
    used = lines.select("file", owner.alias("owner"), F.when(at == 0, "inherits").otherwise("invokes").alias("kind"), name.alias("name")).distinct()
    to = p.select(k.alias("t"), F.concat("file", F.lit(":"), of("c", 5)).alias("t_class"), F.concat("file", F.lit(":"), of("f", 7)).alias("t_function"), F.col("file").alias("t_file"))
    ends = lines.where("l_linenumber = 1").join(to, F.lit(first) + (F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n == F.col("t"))
    dst = F.when(F.col("l_suppkey") % 3 == 0, F.col("t_file")).when(F.col("l_suppkey") % 3 == 1, F.col("t_class")).otherwise(F.col("t_function"))
    targets = ends.select("file", dst.alias("dst"), F.when(F.col("q") % 4 == 0, of("x", 10, "l_suppkey")).alias("alias")).distinct()
    return nodes, used, targets


_CALLEES = f"""{_FACTS},
held as (
  select file, case when kind = 'function' and starts_with(name, 'f') and contains(name, '.') then split_part(name, '.', 1) else '' end as container, string_split(name, '.')[-1] as short, name from nodes),
members as (
  select file as dst, short, file || ':' || name as node from held where container = '' union all select file || ':' || split_part(name, '.', 1), short, file || ':' || name from held where container <> '' and false
  union all select file || ':' || split_part(name, '.', 1), short, file || ':' || name from held where container = '' and contains(name, '.')),
chain as (
  select file as a, dst as b from targets where suffix(dst, '/__init__.py') union select c.a, t.dst from chain c join targets t on t.file = c.b where suffix(t.dst, '/__init__.py')),
seen as (
  select file, dst, alias from targets union select a, dst, alias from chain join targets on file = b where a <> b union select a, b, null from chain where a <> b),
inside as (
  select u.file, owner, u.kind, u.name as short, u.file || ':' || h.name as dst from used u join held h on h.file = u.file and h.short = u.name
  where (container = '' or container = owner or starts_with(owner, container || '.')) and h.name <> owner and not starts_with(owner, h.name || '.')),
far as (
  select file, alias as short, dst from seen where alias is not null union select file, string_split(string_split(dst, ':')[-1], '.')[-1], dst from seen where contains(dst, ':')
  union select file, short, node from seen join members using (dst)),
found as (
  select file || ':' || owner as src, dst, kind as type from inside union select u.file || ':' || owner, dst, kind from used u join far on far.file = u.file and far.short = u.name)"""


@query(f"{_CALLEES} select * from found")
def python_callees(spark, sf_dir):
    """Calls and bases of modules, by scope, alias, and packages that hand names on through others."""
    return N.callees(*facts(spark, sf_dir))


_K = "s_suppkey"
_TEXTS = {
    "q{k}/__init__.py": "from .sub import *\n",
    "q{k}/sub/__init__.py": "from ..deep.core import made{n} as maker, Base\n",
    "q{k}/deep/core.py": "def made{n}():\n    pass\nclass Base:\n    def run(self):\n        made{n}()\n",
    "q{k}/main.py": "import q{k} as q\nfrom q{k}.deep import core\nclass A(Base):\n    def __init__(self):\n        maker()\n    def run(self):\n        def made{n}():\n            pass\n        made{n}()\n        core()\n",
}
_EDGES = [
    ("deep/core.py:Base.run", "deep/core.py:made{n}", "invokes"), ("main.py:A", "deep/core.py:Base", "inherits"), ("main.py:A", "deep/core.py:made{n}", "invokes"),
    ("main.py:A.run", "main.py:A.run.made{n}", "invokes"), ("main.py:A.run", "deep/core.py:made{n}", "invokes"),
]


def _sql(x: str) -> str:
    return "'q' || s_suppkey || '/" + x.replace("{n}", "' || s_nationkey || '") + "'"


@query(" union all ".join(f"select {_sql(a)} as src, {_sql(b)} as dst, '{t}' as type from supplier" for a, b, t in _EDGES))
def python_callees_of_files(spark, sf_dir):
    """The same from the text of files: a package a supplier, with chains of __init__ files."""
    s = table(spark, sf_dir, "supplier")
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("{k}"), F.col(_K).cast("string")), F.lit("{n}"), F.col("s_nationkey").cast("string"))
    files = s.select(F.inline(F.array(*(F.struct(filled(a).alias("file"), filled(b).alias("text")) for a, b in _TEXTS.items()))))
    nodes, used, imports = N.python_names(files)
    return N.callees(nodes, used, N.import_targets(imports, files, nodes)).select("src", "dst", "type")
