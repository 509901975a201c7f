"""The queries opN_<name> over the driver's tables, with production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, conversation_repair, decontamination, embedding_dedup, language_id, lm_scoring, merkle, mixing, ngram_join, pii, quality_rules, substring_dedup, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, what of it stands in benchmark windows of ten words; n_near and near_items: items of which it has all
    words of a window within fifteen, but no window itself."""
    found = decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10, slop=5)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.concat_ws(",", "near_items").alias("near_items"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, how much less a model of the good documents is surprised by it than a model of all others."""
    good = _read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    found = lm_scoring.score(_read(spark, sf_dir, "documents"), good, k=0.1)
    return found.select(F.col("id").alias("doc_id"), "is_target", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its class of near copies (five-word shingles, similarity 0.8 at least) and number of links."""
    found = ngram_join.join(_read(spark, sf_dir, "documents"), threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "class_id", "copy_id", "n_links")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its place in the mixture of all sources by the square roots of their sizes."""
    found = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source"), block=16)
    return found.select("doc_id", "source", "mix_slot", "mix_phase", "mix_position")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, personal data by the base patterns, and with what the trained span classifier adds."""
    found = pii.find(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, what is read back from its formatted text; conversation -1 says control strings."""
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = chat_format.format_trees(chat_format.chains(rows))
    roles, texts = chat_format.read_turns(F.col("formatted"))
    back = found.select("conv", "formatted", roles.alias("roles"), texts.alias("texts"), F.concat_ws("", F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("masked"))
    loss = chat_format.unescape(F.col("masked"))
    turns = F.concat_ws("", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))))
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its language by prototypes learned from the documents that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, prototypes, ["doc_id"])
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its words without those of windows of twenty that stand earlier, too."""
    found = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), size=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its counts, the base rule and the verdict of the threshold table."""
    found = quality_rules.measure(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, its record as read back from the archives written for all pages."""
    found = warc.archive(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, the faults of its damaged rows, and the cheapest repair."""
    rows = _read(spark, sf_dir, "conversations")
    summary, repaired = conversation_repair.repair(conversation_repair.damage(rows))
    convs = rows.select("conv_id").distinct().withColumn("own", conversation_repair.group_of(F.col("conv_id")))
    hashed = conversation_repair.digests(repaired).withColumnRenamed("w_group", "g")
    found = convs.join(summary, F.col("own") == F.col("w_group"), "left").join(hashed, F.col("own") == F.col("g"), "left")
    numbers = (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector, its links with others at a cosine of 0.9 or more, and its component of linked ones."""
    found = embedding_dedup.links(_read(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, its leaf and proof in the manifest of all, and what its leaf leads to where one in seven is tampered with."""
    docs = _read(spark, sf_dir, "documents")
    changed = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf("doc_id", "source", "lang", changed, "text"))
    found = merkle.manifest(docs, carried={"tampered": tampered})
    return found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_repair": op11_repair,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_merkle": op13_merkle,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{x}'" for x in sorted({x for own in quality_rules.STOP_WORDS.values() for x in own}))


def _escaped(column: str) -> str:
    doubled = rf"replace({column}, '\', '\\')"
    angle = rf"regexp_replace({doubled}, '<(\||/?s>|</?SYS>>)', '<\\\1', 'g')"
    square = rf"regexp_replace({angle}, '\[(/?INST\])', '[\\\1', 'g')"
    return rf"regexp_replace({square}, '\|(>)', '|\\\1', 'g')"


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    shifted = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda z: cast(ascii(z) as bigint))), lambda c, b: {shifted}), 4294967295)"


def _least(*states: str) -> str:
    return f"list_min(list_filter([{', '.join(states)}], lambda z: z is not null))"


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state (cost and audit in k, the text so far in t) after an edit."""
    text = f"case when {state}.t is null then {line} else {state}.t || chr(10) || {line} end" if line else f"{state}.t"
    return f"case when {state} is not null then {{'k': printf('%09d', cast({state}.k[1:9] as integer) + {cost}) || {state}.k[10:] || '{letter}', 't': {text}}} end"


def _inserted(source: str) -> str:
    """States of source with u1 and a1: u and a after the turns that may be inserted."""
    first = _least("u", *(_edit(x, "2", "I", "'user:'") for x in "esa"))
    return f"select *, {_least('a', _edit('u1', '2', 'I', chr(39) + 'assistant:' + chr(39)))} as a1 from (select *, {first} as u1 from ({source}))"


def _read_on(letter: str, name: str, before: str, other: str) -> str:
    """The state named by a letter after one more row."""
    fit = f"case when fault not in ('b', 'd') and initial = '{letter}' then {_edit(before, 'charge', 'K', 'line')} end"
    role = f"case when fault not in ('b', 'd') then {_edit(before, '2 + charge', 'R', chr(39) + name + ':' + chr(39) + ' || text')} end" if name else "null"
    return _least(_edit(other, "3", "D"), fit, role)


def _leaf(n_chars: str = "n_chars") -> str:
    said = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"
    return "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Base32 of the hexadecimal digest d: eight letters of every five bytes.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(d, {1 + 10 * g}, 10) as bigint) >> {35 - 5 * j}) & 31 as integer), 1)" for g in range(4) for j in range(8))

ORACLE_SQL = {
    "op1_decontamination": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
iw as (
  select distinct item_id, least(10, len(w)) as n, w[k:k + least(10, len(w)) - 1] as g
  from i, unnest(range(1, len(w) - least(10, len(w)) + 2)) as u(k) where len(w) > 0),
sizes as (select distinct n from iw),
dw as (select doc_id, n, k, w[k:k + n - 1] as g from d, sizes, unnest(range(1, len(w) - n + 2)) as u(k)),
hits as (select doc_id, item_id, k, n from dw join iw using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(k, k + n)) as u(p) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hits group by doc_id),
wanted as (select item_id, g, n + 5 as span, unnest(list_distinct(g)) as x, len(list_distinct(g)) as kinds from (select distinct item_id, n, g from iw)),
spots as (select doc_id, p, w[p] as x from d, unnest(range(1, len(w) + 1)) as u(p) where w[p] in (select x from wanted)),
close as (
  select a.doc_id, t.item_id, t.g, t.kinds, t.span, a.p from spots a join wanted t using (x)),
anchors as (
  select c.doc_id, c.item_id, c.g, c.p, count(distinct o.x) as seen, any_value(c.kinds) as kinds
  from close c join wanted t on t.item_id = c.item_id and t.g = c.g join spots o on o.doc_id = c.doc_id and o.x = t.x and o.p >= c.p and o.p < c.p + c.span
  group by c.doc_id, c.item_id, c.g, c.p),
nearly as (
  select doc_id, count(*) as n_near, string_agg(item_id, ',' order by item_id) as near_items
  from (select distinct doc_id, item_id from anchors where seen = kinds and (doc_id, item_id) not in (select (doc_id, item_id) from hits)) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near, coalesce(near_items, '') as near_items
from d left join words using (doc_id) left join found using (doc_id) left join nearly using (doc_id)""",
    "op8_substring_dedup": rf"""
with d as (select doc_id, {_SPACED} as w from documents),
win as (select doc_id, k, w[k:k + 19] as g from d, unnest(range(1, len(w) - 18)) as u(k)),
ranked as (select doc_id, k, row_number() over (partition by g order by doc_id, k) as r from win),
gone as (select distinct doc_id, p from ranked, unnest(range(k, k + 20)) as u(p) where r > 1),
words as (select doc_id, p, w[p] as x from d, unnest(range(1, len(w) + 1)) as u(p)),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)""",
    "op10_warc": f"""
with p as (select page_id, coalesce(html, '') as h from pages),
x as (select page_id, h, sha1(h) as d, min(page_id) over (partition by h) as o from p)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = o then 'response' else 'revisit' end as record_type, case when page_id = o then null else o end as refers_to
from x""",
    "op9_quality_rules": rf"""
with d as (
  select doc_id, coalesce(text, '') as t, {_SPACED} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
tri as (select doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as g from d, unnest(range(1, len(w) - 1)) as u(k)),
rep as (select doc_id, k from (select *, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
cov as (select doc_id, count(distinct p) as n from rep, unnest(range(k, k + 3)) as u(p) group by doc_id),
m as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
    (length(t) - length(replace(t, '!!', ''))) / 2 as shout, len(l) as n_lines,
    len(list_filter(w, lambda x: list_contains([{_STOPS}], lower(x)))) as stops
  from d left join cov using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1) as g from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / g >= 2 and word_chars / g <= 15 and n_symbols / g <= 0.3e0 and shout / g <= 0.3e0 and stops / g >= 0.05e0
    and n_dup_lines / greatest(n_lines, 1) <= 0.5 as kept
from b""",
    "op6_chat_format": rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, {_escaped("role")} as r, {_escaped("text")} as t from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat_format.OPEN) + len(chat_format.NAMED) + len(chat_format.CLOSE)} + length(r) + length(t)) as bigint) as formatted_chars
from e group by conv_id""",
    "op3_ngram_join": rf"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (
  select distinct doc_id, w[k:k + least(5, len(w)) - 1] as g
  from d, unnest(range(1, len(w) - least(5, len(w)) + 2)) as u(k) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as materialized (
  select x.doc_id as a, y.doc_id as b, count(*) = max(nx.n) and count(*) = max(ny.n) as same
  from s x join s y on x.g = y.g and x.doc_id <> y.doc_id join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
  group by x.doc_id, y.doc_id having count(*) * 1.8 >= 0.8 * (max(nx.n) + max(ny.n))),
reach as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a)
select doc_id, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as class_id,
  least(doc_id, coalesce((select min(b) from pairs where a = doc_id and same), doc_id)) as copy_id,
  (select count(*) from pairs where a = doc_id) as n_links
from d""",
    "op2_lm_scoring": rf"""
with g as (select distinct doc_id from labels where quality = 1 and toxic = 0),
d as (select doc_id, doc_id in (select doc_id from g) as is_target, {_WORDS} as w from documents),
t as (select doc_id, is_target, case when k = 1 then '' else w[k - 1] end as v, w[k] as x from d, unnest(range(1, len(w) + 1)) as u(k)),
vocabulary as (select count(distinct x) as size from t),
own2 as (select doc_id, v, x, is_target, count(*) as n from t group by all),
own1 as (select doc_id, v, is_target, count(*) as n from t group by all),
all2 as (select v, x, sum(n) filter (is_target) as a, sum(n) filter (not is_target) as b from own2 group by v, x),
all1 as (select v, sum(n) filter (is_target) as a, sum(n) filter (not is_target) as b from own1 group by v),
loss as (
  select o.doc_id, o.n,
    ln(coalesce(a1.a, 0) - case when o.is_target then p.n else 0 end + 0.1e0 * size) - ln(coalesce(a2.a, 0) - case when o.is_target then o.n else 0 end + 0.1e0) as lt,
    ln(coalesce(a1.b, 0) - case when o.is_target then 0 else p.n end + 0.1e0 * size) - ln(coalesce(a2.b, 0) - case when o.is_target then 0 else o.n end + 0.1e0) as lb
  from own2 o join own1 p using (doc_id, v) join all2 a2 on a2.v = o.v and a2.x = o.x join all1 a1 on a1.v = o.v, vocabulary),
mean as (select doc_id, sum(n * lt) / sum(n) as lt, sum(n * lb) / sum(n) as lb from loss group by doc_id)
select d.doc_id, is_target, cast(len(w) as bigint) as n_tokens, round(lt, 6) as target_loss, round(lb, 6) as background_loss, round(lt - lb, 6) as score
from d left join mean using (doc_id)""",
    "op11_repair": rf"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind
  from conversations),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from c, unnest(range(case when kind = 3 then 2 else 1 end)) as x(copy) where kind > 0),
placed as (
  select *, coalesce('=' || conv_id, '') as g, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') as said from damaged),
rows as materialized (
  select *, left(role, 1) as initial, role || ':' || text as line,
    case when said = '' then 'b' when row_number() over (partition by g, role, text order by i) > 1 then 'd' when right(said, 1) in ('.', '!', '?') then '-' else 't' end as fault from placed),
costs as materialized (select *, case when fault = 't' then 1 else 0 end as charge from rows),
walk as (
  select distinct g, 0 as i, {{'k': '000000000', 't': cast(null as varchar)}} as e, cast(null as struct(k varchar, t varchar)) as s, cast(null as struct(k varchar, t varchar)) as u, cast(null as struct(k varchar, t varchar)) as a from costs
  union all
  select g, i, {_edit("e", "3", "D")}, {_read_on("s", "", "e", "s")}, {_read_on("u", "user", "v", "u1")}, {_read_on("a", "assistant", "u1", "a1")}
  from (select *, {_least("e", "s", "a1")} as v from ({_inserted("select walk.g, costs.i, e, s, u, a, initial, line, text, fault, charge from walk join costs on costs.g = walk.g and costs.i = walk.i + 1")}))),
ends as (
  select g, {_least("e", "a1")} as best from ({_inserted("select * from walk where (g, i) in (select (g, max(i)) from costs group by g)")})),
pairs as (select g, initial, lag(initial) over (partition by g order by i) as before from costs),
counts as (
  select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated from costs group by g),
illegal as (select g, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from pairs group by g)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cast(best.k[1:9] as bigint), 0) as cost, coalesce(best.k[10:], '') as audit, sha256(coalesce(best.t, '')) as repaired_sha256
from (select distinct conv_id, coalesce('=' || conv_id, '') as g from conversations) left join counts using (g) left join illegal using (g) left join ends using (g)""",
    "op12_embedding_dedup": """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9),
reach as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a, min(b) as b from reach group by a),
n as (select a, count(*) as n from pairs group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(b, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join least on least.a = vec_id""",
    "op13_merkle": f"""
with recursive leaves as materialized (
  select doc_id, coalesce('=' || lang, '') as g, {_leaf()} as leaf,
    case when {_crc32("cast(doc_id as varchar)")} % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf()} end as told from documents),
placed as materialized (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by g) as total from leaves),
tree as (
  select g, 0 as level, place, leaf as node, total from placed
  union all
  select g, level + 1, place // 2, sha256(string_agg(node, '' order by place)), any_value((total + 1) // 2) from tree where total > 1 group by g, level, place // 2),
subroots as materialized (select g, node, row_number() over (order by encode(g)) - 1 as place, count(*) over () as total from tree where total = 1),
top as (
  select 0 as level, place, node, total from subroots
  union all
  select level + 1, place // 2, sha256(string_agg(node, '' order by place)), any_value((total + 1) // 2) from top where total > 1 group by level, place // 2),
nodes as materialized (select g, level, place, node, total from tree union all select 'top', level, place, node, total from top),
climb as (
  select doc_id, leaf, g as own, g, 0 as level, place, told as node, '' as proof from placed
  union all
  select c.doc_id, c.leaf, c.own, case when n.total = 1 then 'top' else c.g end, case when n.total = 1 then 0 else c.level + 1 end, case when n.total = 1 then r.place else c.place // 2 end,
    case when n.total = 1 then c.node when c.place % 2 = 1 then sha256(b.node || c.node) else sha256(c.node || coalesce(b.node, '')) end, c.proof || coalesce(b.node, '')
  from climb c join nodes n on n.g = c.g and n.level = c.level and n.place = c.place join subroots r on r.g = c.own
  left join nodes b on b.g = c.g and b.level = c.level and b.place = xor(c.place, 1)
  where n.total > 1 or c.g <> 'top')
select doc_id, leaf, r.node as subroot, t.node as root, sha256(proof) as proof_sha256, c.node as folded_root, c.node = t.node as verified
from climb c join nodes n on n.g = c.g and n.level = c.level and n.place = c.place join subroots r on r.g = own join top t on t.total = 1
where c.g = 'top' and n.total = 1""",
}
