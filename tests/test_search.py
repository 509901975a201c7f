"""Lines found through a stored index, against plain search of all lines."""

from __future__ import annotations

import random
import re

import pytest

from weftline.operators import search as S

_FILES = "file string, text string"
_TERMS = "term_id long, kind string, term string"


def _plain(files, terms):
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, kind, term in terms:
        for file, text in files:
            if file is None or text is None or term is None:
                continue
            for n, line in enumerate(text.split("\n"), 1):
                if {"text": lambda: term in line, "small": lambda: term.translate(small) in line.translate(small), "regex": lambda: re.search(term, line)}[kind]():
                    yield i, file, n, line


def test_against_all_lines(spark, tmp_path):
    """Files of many blocks, empty and null ones, a name twice, long lines; terms short, unknown, empty and null."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcAB.é𝄞 ") for _ in range(rng.randrange(1, 6)))
    files = [(f"src/{i % 3}/f{i}.py", "\n".join(" ".join(word() for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    files += [("src/0/f0.py", files[0][1]), ("empty", ""), ("null", None), (None, "abc abc"), ("long", "ab" * 50_000 + "zqz" + "ba" * 50_000), ("dot", "ΑΣ ΑΣΑ\nİabc")]
    terms = ["abc", "Bca", "zqz", "a", "", "no such", "é𝄞", "ΑΣ", "b\na", None, ".", "İab"]
    asked = [(2 * i + k, kind, t) for i, t in enumerate(terms) for k, kind in enumerate(("text", "small"))]
    asked += [(100 + i, "regex", t) for i, t in enumerate((r"a+bc?a", r"b\.a", "[abc]{2,3}é", "(abc)?zqz", "^ab|ca$", "(?i)BCA", "ab*c", r"a\Sc", "(ab)(ca)", ""))]
    index = S.stored(spark.createDataFrame(files, _FILES), str(tmp_path), lines=5, buckets=3)
    got = index.search(spark.createDataFrame(asked, _TERMS)).collect()
    assert sorted(tuple(r) for r in got) == sorted(_plain(files, asked))
    # what the letters leave: of the block that has it, and no other
    near, bare = index.candidates(spark.createDataFrame([(0, "text", "zqz"), (1, "text", "zq")], _TERMS))
    assert [(r.term_id, r.file, r.block) for r in near.join(index.blocks(), "id").collect()] == [(0, "long", 0)] and [r.term_id for r in bare.collect()] == [1]
    one = index.search(spark.createDataFrame([(0, "text", "a")], _TERMS), "src/1/*").collect()
    assert {r.file for r in one} == {f for f, _ in files if f and f.startswith("src/1/")}
    assert {r.file for r in index.search(spark.createDataFrame([(0, "text", "zqz")], _TERMS), "nowhere/*").collect()} == {"long"}
    at = index.at(spark.createDataFrame([("dot", 2), ("dot", 3), ("dot", 0), ("dot", 2), ("none", 1), ("src/1/f1.py", 6)], "file string, line_no long")).collect()
    lines = files[1][1].split("\n")
    assert sorted(tuple(r) for r in at) == sorted([("dot", 2, "İabc")] + ([("src/1/f1.py", 6, lines[5])] if len(lines) > 5 else []))


def test_empty_tables(spark, tmp_path):
    index = S.stored(spark.createDataFrame([], _FILES), str(tmp_path))
    assert index.search(spark.createDataFrame([(0, "text", "abc"), (1, "text", "")], _TERMS)).collect() == []
    assert index.search(spark.createDataFrame([], _TERMS)).collect() == []


@pytest.mark.parametrize(
    ("pattern", "runs"),
    [("abc", ["abc"]), ("abcd*e", ["abc"]), (r"foo\.bar+baz", ["foo.bar", "baz"]), ("abc|def", []), ("(abc)?def", ["def"]), ("(abc(de)f)*ghi", ["ghi"]), (r"abc\x41def", []), ("[abc]def", ["def"]), ("[a[b]cde]", []), ("(?i)Abc", ["Abc"]), ("abc(?=d)", []), (r"\Qabc\E", []), ("abcd{0,2}", ["abc"]), (r"abc\d+def?", ["abc"]), ("[]abc]", []), ("ab.cde", ["cde"])],
)
def test_texts_that_matches_must_have(pattern, runs):
    assert [x for x in S.literals(pattern)] == runs
