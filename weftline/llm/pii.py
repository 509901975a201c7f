"""Personal data by weak supervision, in DataFrame functions only.

find() gives the base spans (email, ip, card, phone by their patterns and checks) and adds spans the method finds.
Candidates are looser: cards and phones that stand against other digits, spelled-out addresses, secrets. On each, four
labelers vote for, against or not at all: a strict pattern or checksum, a gazetteer (domains, issuers, country codes,
key prefixes), words before it, and its borders. The votes' patterns are counted over all documents; expectation-
maximisation over these counts estimates every labeler's reliability and with it how likely each pattern is personal
data; with these soft labels a naive Bayes span classifier is trained on features of the span, and it decides.

The driver only sees the counts of (kind, votes, features), at most MOST_PATTERNS by construction, never documents. The
two passes over the text are projections: no join, and only counts are shuffled.

Defined results: a null text is empty and has no spans; offsets count code points, ends are exclusive; of overlapping
added spans the first stays, and base spans always stay; very long texts and runs take time in proportion to their
length; rows that repeat a document are judged each; an empty table
gives an empty result; redact() keeps all columns.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import set_apart

# Kinds in the order of reports.
KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns; possessive and anchored to run starts (or the end of the match before) for linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser patterns of candidates, anchored like those above.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
_OCTETS = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
# Strict patterns, gazetteers and context words of the labelers.
STRICT = {
    "email": r"(?i)(?=.*[^a-z0-9-][a-z]{2,24}$)[a-z0-9._%+-]{1,64}+(?:@| ?[(\[]at[)\]] ?)[a-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[a-z0-9-]++)++",
    "ip": _OCTETS,
    "phone": r"\+[1-9].*",
    "secret": r"AKIA[0-9A-Z]{16}|[0-9a-f]{16,128}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,}",
}
GAZETTEER = {
    "email": r"(?i).*(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)",
    "ip": r"(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|2[3-9][0-9]).*",
    "card": r"(4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|64|65).*",
    "phone": r"\+(1|33|34|39|41|43|44|49|52|54|57)[^0-9].*",
    "secret": r"(AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abps]-|eyJ).*",
}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|host|server|address",
    "card": r"card|visa|master|carte|karte|tarjeta|account",
    "phone": r"tel|phone|call|fax|mobil|fon",
    "secret": r"token|passw|secret|api|key|pwd|credential",
}
LABELERS = ("strict", "gazetteer", "context", "border")
FEATURES = ("kind", "valid", "known", "cued", "length", "shape", "left", "right")
#: Kinds, three votes of four labelers, and the features' values: the table of counts cannot have more rows.
MOST_PATTERNS = len(KINDS) * 3**4 * 6 * 4 * 4 * 4
_BEFORE = 24


#: Characters of a block of text, and 2**_SHIFT elements of a block of running totals: they keep long texts linear.
_BLOCK, _SHIFT = 1024, 6


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _before(values: Column, op, zero: int) -> Column:
    """For every element, op over all those before it. (An aggregate that gathers an array copies it at every step.)"""
    some = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(zero), lambda a, b: op(a, b))
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(values), _SHIFT)), lambda b: F.slice(values, F.shiftleft(b, _SHIFT) + 1, F.lit(1 << _SHIFT)))

    def within(own: Column) -> Column:
        sums = F.transform(own, lambda x: some(x, F.size(x)))
        starts = _let(sums, lambda x: F.transform(x, lambda _, b: some(x, b)))
        return _let(starts, lambda at: F.transform(values, lambda _, i: op(F.get(at, F.shiftright(i, _SHIFT)), some(F.get(own, F.shiftright(i, _SHIFT)), i % (1 << _SHIFT)))))

    return _let(blocks, within)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text, given its blocks."""
    first = F.floor(start / _BLOCK).cast("int")
    own = F.concat_ws("", F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1))
    return F.substring(own, start - first * _BLOCK + 1, end - start)


def _spans(text: Column, pattern: str, guard: Column) -> Column:
    """[start, end, match] of all matches, leftmost and non-overlapping, from the lengths of the pieces between them."""

    def of(gaps: Column, found: Column) -> Column:
        size = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        begin = lambda at, i: F.get(at, i) + F.length(F.get(gaps, i))
        span = lambda at: lambda m, i: F.struct(begin(at, i).alias("start"), (begin(at, i) + F.length(m)).alias("end"), m.alias("m"))
        return _let(size, lambda n: _let(_before(n, lambda x, y: x + y, 0), lambda at: F.transform(found, span(at))))

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    some = lambda found: F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), lambda gaps: of(gaps, found))).otherwise(none)
    return F.when(guard, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether 14 to 19 digits pass the checksum; doubled digits are looked up."""
    d = F.reverse(_digits(m))
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(F.substring(F.lit("0246813579"), digit(i) + 1, F.lit(1)).cast("int")))
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{_OCTETS}$")
    if kind == "card":
        return _luhn(m)
    return F.length(_digits(m)).between(10, 15) if kind == "phone" else F.lit(True)


def _guard(kind: str, text: Column, digit: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    return digit & F.contains(text, F.lit("+")) if kind == "phone" else digit


def base_spans(text: Column, digit: Column) -> dict[str, Column]:
    holds = lambda kind: lambda s: _holds(kind, s["m"])
    return {k: F.filter(_spans(text, p, _guard(k, text, digit)), holds(k)) for k, p in BASE.items()}


def _candidates(text: Column, digit: Column) -> Column:
    """All candidates with kind, match and their surroundings."""

    def of(k: str) -> Column:
        guard = F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]") if k == "email" else _guard(k, text, digit)
        return F.transform(_spans(text, LOOSE[k], guard), lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), *(s[n].alias(n) for n in ("start", "end", "m"))))

    def around(blocks: Column, s: Column) -> Column:
        before = F.lower(_cut(blocks, F.greatest(s["start"] - _BEFORE, F.lit(0)), s["start"]))
        return F.struct(*(s[n].alias(n) for n in ("kind", "start", "end", "m")), before.alias("before"), _cut(blocks, s["end"], s["end"] + 1).alias("after"))

    none = F.array().cast("array<struct<kind:int,start:int,end:int,m:string,before:string,after:string>>")
    within = lambda found: F.when(F.size(found) > 0, _let(_blocks(text), lambda blocks: F.transform(found, lambda s: around(blocks, s)))).otherwise(none)
    return _let(F.concat(*(of(k) for k in LOOSE)), within)


def _by_kind(c: Column, per: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, v in per.items():
        out = F.when(c["kind"] == KINDS.index(k), v).otherwise(out)
    return out


def _edge(x: Column) -> Column:
    """0 nothing, 1 white space, 2 punctuation, 3 a letter, digit or other sign that runs on."""
    return F.when(x == "", 0).when(x.rlike(r"^\s"), 1).when(x.rlike(r"""^[."'=:;,(){}<>|!?\[\]]"""), 2).otherwise(3)


def _judge(c: Column) -> Column:
    """Votes (1 for, -1 against, 0 none) and features of a candidate."""
    m, before = c["m"], c["before"]
    sign = lambda ok, other: F.when(ok, 1).otherwise(other)
    full = lambda p: m.rlike(f"^(?:{p})$")
    strict = {k: sign(full(p) & _holds(k, m), -1) for k, p in STRICT.items()} | {"card": sign(_luhn(m), -1)}
    gazetteer = {k: sign(full(p), 0) for k, p in GAZETTEER.items()}
    context = {k: sign(before.rlike(p), 0) for k, p in CONTEXT.items()}
    left = _edge(F.substring(before, -1, 1))
    right = _edge(c["after"])
    n = F.length(m)
    length = F.when(n < 8, 0).when(n < 12, 1).when(n < 17, 2).when(n < 24, 3).when(n < 41, 4).otherwise(5)
    shape = F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike("^[0-9a-f]+$"), 1).when(m.rlike("^[A-Z0-9]+$"), 2).otherwise(3)
    votes = [_by_kind(c, strict), _by_kind(c, gazetteer), _by_kind(c, context), F.when((left < 3) & (right < 3), 1).otherwise(-1)]
    names = [*LABELERS, "length", "shape", "left", "right"]
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *(v.cast("int").alias(k) for k, v in zip(names, [*votes, length, shape, left, right], strict=True)))


def _prepared(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, text.alias("w_text")).select("*", F.col("w_text").rlike("[0-9]").alias("w_digit"))


def counts(docs: DataFrame, text_col: str = "text") -> list[tuple[tuple[int, ...], int]]:
    """How often every (kind, votes, features) occurs in all documents."""
    names = ["kind", *LABELERS, "length", "shape", "left", "right"]
    found = _prepared(docs, [], text_col).select(_candidates(F.col("w_text"), F.col("w_digit")).alias("c"))
    judged = found.select(F.explode(F.transform("c", _judge)).alias("j")).groupBy(*(F.col(f"j.{n}").alias(n) for n in names)).count()
    rows = judged.limit(MOST_PATTERNS).collect()  # a bound by construction: it never cuts
    return sorted((tuple(r[n] for n in names), r["count"]) for r in rows)


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], dict[str, dict[int, dict[int, float]]]]:
    """EM over the counts: P(personal data | kind, votes), and P(vote | class) of every labeler.

    A labeler's reliability is shared by all kinds. A prior of one percent of all candidates (and five) says that
    labelers are right more often than not, which also tells the classes apart.
    """
    n = defaultdict(float)
    for row, k in table:
        n[row[:5]] += k
    keys = sorted(n)
    total = sum(n.values())
    anchor = 5 + 0.01 * total
    q = {k: 1 / (1 + math.exp(-1.5 * sum(k[1:]))) for k in keys}
    theta: dict[str, dict[int, dict[int, float]]] = {}
    for _ in range(rounds):
        prior = {}
        for kind in range(len(KINDS)):
            own = [k for k in keys if k[0] == kind]
            prior[kind] = (2 + sum(n[k] * q[k] for k in own)) / (4 + sum(n[k] for k in own))
        for i, name in enumerate(LABELERS):
            theta[name] = {}
            for y in (0, 1):
                weight = {v: 1 + anchor * (v == 2 * y - 1) for v in (-1, 0, 1)}
                for k in keys:
                    weight[k[1 + i]] += n[k] * (q[k] if y else 1 - q[k])
                s = sum(weight.values())
                theta[name][y] = {v: w / s for v, w in weight.items()}
        for k in keys:
            odds = math.log(prior[k[0]] / (1 - prior[k[0]])) + sum(math.log(theta[x][1][k[1 + i]] / theta[x][0][k[1 + i]]) for i, x in enumerate(LABELERS))
            q[k] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
    return q, theta


def train(table: list[tuple[tuple[int, ...], int]]) -> tuple[float, dict[str, dict[int, float]]]:
    """Naive Bayes on the soft labels: the prior's log-odds and those of every feature's values."""
    q, _ = reliabilities(table)
    weight = {f: defaultdict(lambda: [0.5, 0.5]) for f in FEATURES}
    both = [1.0, 1.0]
    for row, k in table:
        kind, strict, gazetteer, context, _, *rest = row
        values = (kind, strict, gazetteer, context, *rest)
        for y, w in ((1, k * q[row[:5]]), (0, k * (1 - q[row[:5]]))):
            both[y] += w
            for f, v in zip(FEATURES, values, strict=True):
                weight[f][v][y] += w
    odds = {f: {v: math.log(w[1] / both[1]) - math.log(w[0] / both[0]) for v, w in sorted(own.items())} for f, own in weight.items()}
    return math.log(both[1] / both[0]), odds


def _score(j: Column, model: tuple[float, dict[str, dict[int, float]]]) -> Column:
    column = {"valid": "strict", "known": "gazetteer", "cued": "context"}
    parts = [F.lit(model[0])]
    for f, own in model[1].items():
        x = j[column.get(f, f)]
        part = F.lit(0.0)
        for v, w in own.items():
            part = F.when(x == v, w).otherwise(part)
        parts.append(part)
    return reduce(lambda a, b: a + b, parts)


def find(docs: DataFrame, keep: list[str], text_col: str = "text", model=None) -> DataFrame:
    """The kept columns, base (per kind counts n_<kind>, base spans) and spans: arrays of (start, kind, end), sorted.

    Without a model one is trained on these documents. Where a kept column has the name of a new one, the new one gets a
    further underscore.
    """
    apart = set_apart(docs, keep, text_col, (*(f"n_{k}" for k in KINDS), "base", "spans"), lambda d, ids, text: find(d, ids, text, model))
    if apart is not None:
        return apart
    model = model or train(counts(docs, text_col))
    text, digit = F.col("w_text"), F.col("w_digit")
    base = base_spans(text, digit)
    span = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    a = _prepared(docs, [F.col(f"`{c}`") for c in keep], text_col)
    own = [F.col(f"`{c}`") for c in keep]
    b = a.select(*own, *(F.transform(v, span(KINDS.index(k))).alias(f"w_{k}") for k, v in base.items()), _candidates(text, digit).alias("w_found"))
    c = b.select(*own, *(F.size(f"w_{k}").cast("long").alias(f"n_{k}") for k in base), F.array_sort(F.concat(*(F.col(f"w_{k}") for k in base))).alias("base"), F.transform("w_found", _judge).alias("w_judged"))
    good = F.filter("w_judged", lambda j: _score(j, model) >= 0)
    plain = F.array_sort(F.transform(good, lambda j: F.struct(j["start"].alias("start"), j["kind"].alias("kind"), j["end"].alias("end"))))
    names = [*(f"n_{k}" for k in base), "base"]
    d = c.select(*own, *names, plain.alias("w_added"))
    e = d.select(*own, *names, F.when((F.size("w_added") > 0) & (F.size("base") > 0), _free_of(F.col("base"), F.col("w_added"))).otherwise(F.col("w_added")).alias("w_free"))
    return e.select(*own, *names, F.array_sort(F.concat("base", _let(F.col("w_free"), _apart))).alias("spans"))


def _free_of(base: Column, added: Column) -> Column:
    """Added spans that overlap no base span: by start, none before reaches into them and none after begins in them."""
    marked = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("added"), s["kind"].alias("kind"), s["end"].alias("end")))
    last = (1 << 31) - 1
    of_base = lambda x, field, other: F.when(x["added"] == 0, x[field]).otherwise(F.lit(other))

    def within(every: Column) -> Column:
        reach = _let(F.transform(every, lambda x: of_base(x, "end", 0)), lambda v: _before(v, F.greatest, 0))
        begin = F.reverse(_let(F.reverse(F.transform(every, lambda x: of_base(x, "start", last))), lambda v: _before(v, F.least, last)))
        free = lambda r, b: F.filter(every, lambda x, i: (x["added"] == 1) & (F.get(r, i) <= x["start"]) & (F.get(b, i) >= x["end"]))
        return _let(reach, lambda r: _let(begin, lambda b: free(r, b)))

    found = _let(F.array_sort(F.concat(marked(base, 0), marked(added, 1))), within)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _apart(spans: Column) -> Column:
    """Of overlapping spans the first, again and again; without any, all."""
    ddl = "array<struct<start:int,kind:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(ddl).alias("out"))
    greedy = F.aggregate(spans, zero, lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a), lambda a: a["out"])
    near = F.filter(spans, lambda s, i: (i > 0) & (s["start"] < F.get(spans, i - 1)["end"]))
    return F.when(F.size(near) > 0, greedy).otherwise(spans)


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text", model=None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; null texts stay null."""
    row = "w_row"
    while row in docs.columns:
        row += "_"
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)).select(row, F.col(f"{row}.`{text_col}`").alias("w_own"))
    found = find(whole, [row], "w_own", model).select(row, "spans")
    text = F.col(f"{row}.`{text_col}`")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def parts(at: Column, blocks: Column) -> Column:
        piece = lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(_cut(blocks, F.get(at, i), s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(F.lit(""))
        last = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.concat_ws("", F.transform("spans", piece)), _cut(blocks, last, F.length(text)))

    at = _let(F.transform("spans", lambda s: s["end"]), lambda v: _before(v, F.greatest, 0))
    clean = _let(at, lambda a: _let(_blocks(text), lambda blocks: parts(a, blocks)))
    new = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*(new.alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
