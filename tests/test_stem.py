import math
import re
from collections import Counter

import duckdb
import pytest

from weftline.functions.stem import STOP_WORDS, stem
from weftline.operators import retrieval as R
from weftline.plans import QUERIES

# From the published sample vocabulary of the algorithm.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consists consist consolation consol consolatory consolatori
console consol consolidate consolid consolidating consolid consolingly consol consonant conson consorted consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspire conspir constable constabl
constance constanc constancy constanc knackeries knackeri knacks knack knave knave knavish knavish kneaded knead knee knee
knees knee knelt knelt knife knife knightly knight knitted knit knitting knit knives knive knocker knocker knopp knopp
skies sky dying die news news inning inning proceed proceed generously generous happy happi hoping hope hopping hop
relational relat ties tie cries cri gas gas gaps gap say say by by cry cri agreed agre feed feed luxuriated luxuri"""


def test_published_pairs():
    words = PAIRS.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


def test_stemmed_chunks(spark):
    lines = [f"line {i} of the filler" for i in range(300)]
    lines[250] = "the conspirators were consoling the knights"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "a knight consoled")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "Consoled knights, conspiring")], "query_id long, text string")
    got = R.chunk_bm25(docs, queries, k=5, lines=120, step=100).orderBy("rank").collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == {(1, 201, 300), (3, 1, 1)} and [r.rank for r in got] == [1, 2]
    assert not STOP_WORDS & {stem("knights")}


def test_whole_tables(spark, sf_dir):
    """The query against BM25 by hand over all chunks."""
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()

    def bag(text):
        words = [stem(w) for w in re.findall(r"[a-z0-9_][a-z0-9_']+", (text or "").lower()) if w not in STOP_WORDS]
        whole = re.findall(r"[a-z_$][a-z0-9_$]*|[0-9]+", " ".join(words))
        return Counter(whole + [p for w in whole if "_" in w for p in w.replace("_", " ").split() if p != w])

    chunks = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        for at in range(0, len(lines), 100):
            own = bag("\n".join(lines[at : at + 120]))
            if own:
                chunks[doc, at + 1] = own
    df = Counter(t for b in chunks.values() for t in b)
    mean = sum(sum(b.values()) for b in chunks.values()) / len(chunks)
    want = {}
    for item, text in items:
        asked, scores = bag(text), {}
        for place, own in chunks.items():
            length = sum(own.values())
            scores[place] = round(sum(min(n, 3) * math.log(1 + (len(chunks) - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * 2.5 / (own[t] + 1.5 * (0.25 + 0.75 * length / mean)) for t, n in asked.items() if t in own), 6)
        want[item] = sorted(((-v, p) for p, v in scores.items() if v > 0))[:10]
    got = {}
    for r in sorted(QUERIES["bm25_stemmed_chunks"](spark, sf_dir).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((-r.score, (r.doc_id, r.start)))
    assert {k: [s for s, _ in v] for k, v in got.items()} == {k: pytest.approx([s for s, _ in v], abs=2e-6) for k, v in want.items() if v}
    assert sum(p == q for k in got for (_, p), (_, q) in zip(got[k], want[k], strict=True)) >= 0.99 * sum(map(len, got.values()))
