"""Queries of source files of many shapes: each document's words, four a line, in lines of changing form."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weftline.operators import code as C
from weftline.plans.registry import query
from weftline.session import cut, spread, table

SHAPES = (
    "export class {a} extends {b} {",
    "  async {c}({d}) {",
    "}",
    "const {a} = function ({b}) {",
    "{A}.prototype.{b} = function () { return {c}({d}) }",
    "module.exports = class {a} {",
    "let {a} = async ({b}) => {",
    "  } // { {a}",
    "if ({a}) {",
    "function {a}({b})",
    "# class {a} {",
    "  public static List<{A}> {b}(int x) throws {C} {",
    "struct {a} { }",
    "func {a}({b}) {",
    "{a} {b} }",
    "const app = { routes: [ {a} ] }",
    "import { {a} } from './{b}'",
    "import type { {A} } from '{b}'",
    "export { {a} as {b}, {c} }",
    "return <{A} x={1}>new {B}({c}.{d}({a}))",
    "{a}.setState(use{B}(dispatch({c})))",
    "<{A}.Provider element={<{B} />} />",
    "class {A} implements {B}, {C} { } }",
    "var {a} = {b} => {c} as {D};",
)
_SUFFIXES = ("js", "ts", "java", "go", "rs", "md")


def _pieces(shape: str):
    """Structs before, word, upper: what stands before each of a line's words, and which word it is; the last without one."""
    parts = [*re.split(r"\{([A-Da-d])\}", shape), None]
    for before, letter in zip(parts[::2], parts[1::2], strict=True):
        word = F.lit(letter and "abcd".index(letter.lower())).cast("int")
        yield F.struct(F.lit(before).alias("before"), word.alias("word"), F.lit(bool(letter and letter.isupper())).alias("upper"))


def files(spark, sf_dir):
    """file, text: one a document, of its whole text."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.lower(w))
    shapes = F.array(*(F.array(*_pieces(x)) for x in SHAPES))
    # no filter on the words, which would go below and take them from the text once more
    named = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.filter(F.array(words), lambda w: F.size(w) >= 4)).alias("w"))

    def line(i):
        def piece(p):
            word = F.get("w", i * 4 + p["word"])
            return F.concat_ws("", p["before"], F.when(p["upper"], F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 30))).otherwise(word))

        form = F.element_at(shapes, (F.pmod(i * 5 + F.col("doc_id"), F.lit(len(SHAPES))) + 1).cast("int"))
        return F.array_join(F.transform(form, piece), "")

    lines = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 4).cast("int") - 1), line)
    name = F.concat(F.lit("d"), "doc_id", F.lit("."), F.element_at(F.array(*(F.lit(x) for x in _SUFFIXES)), (F.pmod("doc_id", F.lit(len(_SUFFIXES))) + 1).cast("int")))
    return named.select(name.alias("file"), F.array_join(lines, "\n").alias("text"))


def _sql_line() -> str:
    out = f"[{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in SHAPES)}][1 + (i * 5 + doc_id) % {len(SHAPES)}]"
    for k, letter in enumerate("abcd"):
        out = f"replace(replace({out}, '{{{letter}}}', w[4 * i + {k + 1}]), '{{{letter.upper()}}}', upper(w[4 * i + {k + 1}][1]) || w[4 * i + {k + 1}][2:])"
    return out


_FILES = f"""w as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]{{3,}}'), lambda x: lower(x)) as w from documents),
lines as materialized (
  select 'd' || doc_id || '.' || [{', '.join(f"'{x}'" for x in _SUFFIXES)}][1 + doc_id % {len(_SUFFIXES)}] as file, i + 1 as n, {_sql_line()} as line from w, unnest(range(len(w) // 4)) as u(i))"""


def _sql_pattern(name: str) -> str:
    out = "null"
    for kind, p in reversed(C.DEFINITIONS[name]):
        x = f"regexp_extract(line, '{p}', 1)"
        out = f"case when {x} <> '' and {x} not in {C.KEYWORDS} then {{'kind': '{kind}', 'name': {x}}} else {out} end"
    return out


_ENTITIES = f"""with {_FILES},
hits as (
  select file, n, regexp_replace(line, '//.*$', '') as code,
    case when regexp_matches(line, '^\\s*(//|\\*|#)') then null when suffix(file, '.js') or suffix(file, '.ts') then {_sql_pattern("javascript")} when suffix(file, '.java') then {_sql_pattern("java")}
      when suffix(file, '.md') then null else {_sql_pattern("other")} end as hit from lines),
steps as (select *, length(code) - length(replace(code, '{{', '')) as opened, length(code) - length(replace(code, '}}', '')) as closed from hits),
levels as materialized (
  select file, n, hit, sum(opened - closed) over w as level, sum(opened - closed) over w - opened + closed as base,
    min(case when opened > 0 then n end) over (partition by file order by n rows between current row and unbounded following) as o
  from steps window w as (partition by file order by n)),
heads as (select * from levels where hit is not null),
ends as (select h.file, h.n, min(l.n) as e from heads h join levels l on l.file = h.file and l.n >= h.o and l.level <= h.base group by all),
found as materialized (select file, hit.kind as kind, hit.name as name, n as start_line, coalesce(e, n) as end_line from heads left join ends using (file, n)),
owned as (
  select m.file, m.start_line, arg_min(c.name, (c.end_line - c.start_line) * 1000000 + c.start_line) as class
  from found m join found c on c.file = m.file and c.kind = 'class' and c.start_line < m.start_line and m.start_line <= c.end_line where m.kind = 'method' group by all),
entities as materialized (
  select file, kind, name, coalesce(class || '.', '') || name as qualified_name, cast(start_line as integer) as start_line, cast(end_line as integer) as end_line from found left join owned using (file, start_line))"""


@query(f"{_ENTITIES} select * from entities")
def code_entities_of_shapes(spark, sf_dir):
    """Definitions in lines of many shapes, in four languages, with blocks that close late or never."""
    return C.pattern_entities(files(spark, sf_dir)).select("file", "kind", "name", "qualified_name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


_MENTIONED = [k for k in C.RELATIONS if k != "type_imports"]
_MENTIONS = f"""texts as (select file, string_agg(line, chr(10) order by n) as text from lines group by file),
said as (
  {" union ".join(f"select file, '{k}' as type, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)) as target from texts" for k in _MENTIONED for p in C.RELATIONS[k])}
  union select file, k, trim(split_part(trim(x), ' as ', 1)) from (
    select file, k, unnest(string_split(items, ',')) as x from ({" union all ".join(f"select file, '{k}' as k, unnest(regexp_extract_all(text, '{p}', 1)) as items from texts" for k, p in C.LISTS.items())}))
  union select file, 'type_imports', regexp_extract(line, 'from ''([^'']+)''', 1) from lines where regexp_matches(line, '^ *import +type ')),
mentioned as materialized (
  select * from said where target <> '' and (type <> 'uses_style' or regexp_matches(target, '\\.s?css$')) and not (type = 'calls' and split_part(target, '.', 1) in {C.NOT_CALLS}))"""


@query(f"with {_FILES}, {_MENTIONS} select file, type, target from mentioned")
def code_mentions_of_shapes(spark, sf_dir):
    """All relations that lines of many shapes name."""
    return C.mentions(files(spark, sf_dir))


@query(
    f"""{_ENTITIES}, {_MENTIONS},
r as (select file, type, target, string_split(target, '.')[-1] as short from mentioned),
e as (select file, qualified_name, name, file || '::' || qualified_name as id from entities),
own as (select r.file, type, target, min(case when qualified_name = target then id end) as exact, min(id) as near from r join e on e.file = r.file and e.name = short group by all),
far as (select name, min(id) as id from e group by name),
told as (
  select r.file as src, coalesce(exact, near, case when r.type <> 'exports' then far.id end, case when r.type in {C.OWN_FILE} then r.file end) as dst, r.type
  from r left join own using (file, type, target) left join far on far.name = short)
select distinct src, dst, type from told where dst is not null"""
)
def code_symbols_of_shapes(spark, sf_dir):
    """These relations resolved to entities, in the own file first."""
    f = cut(files(spark, sf_dir))  # read twice
    return C.symbol_edges(C.mentions(f), C.pattern_entities(f)).select("src", "dst", "type")
