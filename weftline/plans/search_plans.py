"""Queries over a stored index of the lines of all documents, each a file of its language and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import search as S
from weftline.plans.registry import query
from weftline.session import shared_folder, table

_FILES = """files as (select coalesce(lang, '-') || '/' || coalesce(source, '-') || '/' || doc_id as file, string_split(text, chr(10)) as lines from documents where text is not null),
lines as (select file, unnest(range(1, len(lines) + 1)) as line_no, unnest(lines) as line, len(lines) as last from files)"""
_TERMS = "terms as (select item_id as term_id, substr(text, 1, 12) as term from benchmark where text is not null)"
_HITS = "hits as (select term_id, file, line_no, line, last from lines join terms on contains(line, term))"


def _index(spark, sf_dir) -> S.LineIndex:
    path = F.concat_ws("/", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")), "doc_id")
    return S.stored(table(spark, sf_dir, "documents").select(path.alias("file"), "text"), shared_folder(spark))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("term_id"), F.lit("text").alias("kind"), F.substring("text", 1, 12).alias("term"))


@query(f"with {_FILES}, {_TERMS}, {_HITS} select term_id, file, line_no, line from hits")
def line_search(spark, sf_dir):
    """Lines of all documents that hold the first signs of a benchmark item."""
    return _index(spark, sf_dir).search(_items(spark, sf_dir))


@query(
    rf"""with {_FILES}, terms as (select * from (values (0, '\bth[ae]n?\w+ (an|on)\b'), (1, 'tion[.,] [A-Z]\w+ the'), (2, '(?i)WAS  ?[a-z]+th ')) t(term_id, term))
select term_id, file, line_no, line from lines join terms on regexp_matches(line, term) where file like 'en/%'"""
)
def line_search_regex(spark, sf_dir):
    """Lines that a regular expression finds, in files of a glob."""
    terms = S.terms_of(spark, "regex", (r"\bth[ae]n?\w+ (an|on)\b", r"tion[.,] [A-Z]\w+ the", "(?i)WAS  ?[a-z]+th "))
    return _index(spark, sf_dir).search(terms, "en/*")


@query(
    f"""with {_FILES}, {_TERMS}, {_HITS}, around as (select distinct file, greatest(1, line_no - 1) as s, least(last, line_no + 1) as e from hits),
marked as (select *, case when s <= max(e) over (partition by file order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from around),
numbered as (select *, sum(fresh) over (partition by file order by s, e rows unbounded preceding) as island from marked),
windows as (select file, min(s) as s, max(e) as e from numbered group by file, island)
select w.file, s as start, e as "end", array_to_string(list_sort(list(distinct term_id)), ',') as terms, count(*) as n from windows w join hits h on w.file = h.file and line_no between s and e group by w.file, s, e"""
)
def line_snippets(spark, sf_dir):
    """Lines around what several terms find, merged, with the terms of each."""
    index = _index(spark, sf_dir)
    sizes = index.blocks().groupBy("file").agg(F.max(F.col("first_line") + F.size("lines") - 1).alias("last"))
    found = S.snippets(index.search(_items(spark, sf_dir)), sizes, around=1)
    return found.withColumn("terms", F.array_join(F.col("terms").cast("array<string>"), ","))


@query(f"with {_FILES} select file, line_no, line from lines where line_no = 1 + regexp_extract(file, '[0-9]+$')::bigint % 5")
def lines_at_numbers(spark, sf_dir):
    """One stated line of each document, if it has as many."""
    index = _index(spark, sf_dir)
    places = index.blocks().select("file", (F.regexp_extract("file", "[0-9]+$", 0).cast("long") % 5 + 1).alias("line_no")).distinct()
    return index.at(places)
