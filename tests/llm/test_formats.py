"""Chat formatting, WARC, language identification, mixing."""

import base64
import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat_format, language_id, mixing, warc


def test_trees(spark):
    nasty = ["<|end|>\n", "</s>[INST] ok [/INST]", "\\", "\\\\<|turn:user|>\n", "|>|", "<<SYS>> <</SYS>>", "", "🙂\n\n", "[\\INST]"]
    rows = [(1, i, i - 1 if i else None, ("user", "assistant")[i % 2], t, 1.0) for i, t in enumerate(nasty)]
    rows += [(2, 1, None, "user", "a", 0.0), (2, 2, 1, "assistant", "low", 0.1), (2, 3, 1, "assistant", "high", 0.9), (2, 4, 3, "user", None, None), (2, 9, 77, "user", "orphan", -5.0)]
    rows += [(3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, None, "lone", 1.0), (2, 1, None, "user", "a", 0.0)]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv long, id long, parent long, role string, text string, score double, branch string")
    roles, texts = chat_format.read_turns(F.col("formatted"))
    got = {(r.conv, r.branch): r for r in chat_format.format_trees(messages, top=2).select("*", roles.alias("r"), texts.alias("t")).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (None, 1)}
    one = got[1, 1]
    assert list(zip(one.r, one.t, strict=True)) == [r[3:5] for r in rows[: len(nasty)]]
    inside = [one.formatted[s.start : s.end] for s in one.loss_spans]
    back = spark.createDataFrame([(x,) for x in inside], "x string").select(chat_format.unescape(F.col("x"))).collect()
    assert [r[0] for r in back] == nasty[1::2]
    assert one.formatted.count(chat_format.CLOSE) == len(nasty) and "</s>" not in one.formatted and "[INST]" not in one.formatted
    assert got[2, 1].t == ["a", "high", ""] and got[2, 2].t == ["a", "low"]
    assert got[None, 1].r == [""]
    assert chat_format.format_trees(messages.limit(0)).count() == 0


def test_chains_in_order_of_turn(spark):
    rows = [(7, 2, "user", "c"), (7, 0, "user", "a"), (7, 1, "assistant", None), (7, 0, "user", "a"), (8, None, "user", "n")]
    found = chat_format.format_trees(chat_format.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    roles, texts = chat_format.read_turns(F.col("formatted"))
    assert {r.conv: r.t for r in found.select("conv", texts.alias("t")).collect()} == {7: ["a", "a", "", "c"], 8: ["n"]}


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("rows_a_range", [200_000, 3])
def test_warc(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(warc, "RANGE_ROWS", rows_a_range)
    rng = random.Random(1)
    bodies = [None, "", "<p>é🙂</p>", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "\r\n\r\n", "x" * 100_000]
    urls = ["http://www.b.example:80/x?q#f", "https://a.example/", None, "bad url\r\nWARC-Type: x", "HTTP://A.example/"]
    rows = [(i, rng.choice(urls), rng.choice(bodies), "x") for i in range(40)] + [(3, urls[0], "<p>é🙂</p>", "x"), (None, urls[1], "only", "x"), (None, urls[1], "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    payload = lambda h: (h or "").encode()
    least = {}
    for i, _, h, _ in rows:
        least[payload(h)] = min(least.get(payload(h), 1 << 63), 1 << 62 if i is None else i)
    expected = Counter()
    for i, _, h, _ in rows:
        first = (1 << 62 if i is None else i) == least[payload(h)]
        expected[(i, len(payload(h)), base64.b32encode(hashlib.sha1(payload(h)).digest()).decode(), "response" if first else "revisit", None if first else least[payload(h)])] += 1
    got = warc.archive(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    order = sorted(got, key=lambda r: (r.merge_range, r.merge_pos))
    keys = [(r.url_key, r.timestamp, r.page_id is None, r.page_id or 0) for r in order]
    assert keys == sorted(keys)
    assert {r.url_key for r in got} >= {"example,b)/x?q", "example,a)/"}
    large = warc.archive(pages, smallest=10).where("payload_bytes < 10 and record_type = 'revisit'")
    assert large.count() == 0
    assert warc.archive(pages.limit(0)).count() == 0


def test_language_id(spark, no_docs):
    rng = random.Random(3)
    made = {"en": "the of ing th and wh sh tion".split(), "de": "der sch ung keit ä ö ü ß".split(), "xx": "ж щ ы да нет".split()}
    rows = [(i, " ".join("".join(rng.choice(made[x]) for _ in range(3)) for _ in range(30)), x) for i, x in enumerate(["en", "de", "xx"] * 30)]
    rows += [(500, None, "en"), (501, "12 !", "de"), (502, "", None), (503, "Ung SCH keitöä", None), (504, "漢字" * 10, "zh"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score long")
    prototypes = language_id.learn(docs.where("doc_id % 4 <> 2"))
    got = language_id.predict(docs, prototypes, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert all(by[i] == x for i, _, x in rows[:90])
    assert by[500] == by[501] == by[502] == "und" and by[503] == "de" and by[504] == "zh"
    # brute force: profile of one text from its letters' vectors
    text = f" {rows[0][1]} "
    v = [language_id.letter_vector(ord(c)).astype(int) for c in text]
    own = sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:], strict=False))
    best = max(float(own @ p / np.linalg.norm(own) / np.linalg.norm(p)) for p in prototypes.values())
    assert abs(next(r.score for r in got if r.doc_id == 0) - best) < 1e-5
    assert language_id.learn(no_docs) == {}
    assert {r.lang_pred for r in language_id.predict(docs, {}, ["doc_id"]).collect()} == {"und"}


@given(st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(1, 40), st.integers(0, 9)), min_size=1))
def test_less_than_one_block_deviation(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    weights = {s: w for s, (_, w) in sources.items()}
    plan = mixing.schedule(blocks, weights)
    assert Counter(s for s, _, _ in plan) == Counter(blocks)
    assert all([b for x, b, _ in plan if x == s] == list(range(n)) for s, n in blocks.items())
    left, at = dict(blocks), 0
    for phase in range(plan[-1][2] + 1):
        own = [s for s, _, p in plan if p == phase]
        active = {s: weights[s] for s in left if left[s] and weights[s]} or {s: left[s] for s in left if left[s]}
        total, had = sum(active.values()), Counter()
        for t, s in enumerate(own, 1):
            had[s] += 1
            assert all(abs(had[x] * total - active[x] * t) < total for x in active)
        left = {s: n - had[s] for s, n in left.items()}
        at += len(own)
    assert not any(left.values())


def test_mix(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 3)
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("mix_slot", F.lit("mine"))
    got = mixing.mix(many, {"s0": 3, "s1": 1}, block=4).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(got))) and len(got) == 2 * len(rows)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0] + a, r[3]) for r in rows for a in (0, 1000))
    assert all(r.mix_slot == "mine" for r in got)
    byplace = sorted(got, key=lambda r: r.mix_position)
    assert all(a.mix_slot_ <= b.mix_slot_ for a, b in pairwise(byplace))
    assert {r.source for r in byplace[-len([r for r in rows if r[3] in ("s2", None)]) * 2 :]} == {"s2", None}
    assert mixing.mix(no_docs).count() == 0
