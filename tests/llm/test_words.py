import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from weftline.llm import words as W

PATTERN = {"letters": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "spaced": r"[^\x20\x09-\x0D]+"}


def plain(text, kind):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if kind == "letters" else text or ""
    return re.findall(PATTERN[kind], text)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é \t\n-|漢", max_size=30)), max_size=8))
def test_words_and_windows(texts):
    for kind in PATTERN:
        w = W.words_of(pa.array(texts, pa.string()), kind)
        expected = [plain(t, kind) for t in texts]
        flat = [x for e in expected for x in e]
        assert np.diff(w.first).tolist() == [len(e) for e in expected]
        assert len(set(zip(flat, w.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes.tolist()))
        runs = W.windows(w.hashes, 2)[W.whole(w.rows, 2)].tolist()
        pairs = [tuple(e[i : i + 2]) for e in expected for i in range(len(e) - 1)]
        assert len(set(zip(pairs, runs, strict=True))) == len(set(pairs)) == len(set(runs))


def test_slices_of_arrays_and_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE_BYTES", 10)
    column = pa.array(["skip", "one two", None, "three four five six seven", ""], pa.string()).slice(1)
    w = W.words_of(column, "spaced")
    assert np.diff(w.first).tolist() == [2, 0, 5, 0]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == "one two three four five six seven".split()
