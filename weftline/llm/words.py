"""Vectorised words and word hashes of Arrow string columns.

Both word definitions used here are byte-wise: every byte of a multi-byte UTF-8 character is a word byte, so a
256-entry table decides. Words never cross rows. A word's hash is the mixed sum of one pseudo-random 64-bit value for
every (place in the word, byte); a window's hash is mixed from those of its two parts, down to single words. Neither is
a polynomial, so words of regular patterns (such as Thue-Morse words) collide no more than others.
"""

from __future__ import annotations

import contextlib
import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SPACE_WORD = np.ones(256, bool)
_SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LETTER_WORD = np.ones(256, bool)
_LETTER_WORD[0x00:0x30] = _LETTER_WORD[0x3A:0x41] = _LETTER_WORD[0x5B:0x61] = _LETTER_WORD[0x7B:0x80] = False

_GOLDEN = U(0x9E3779B97F4A7C15)
#: Places in a word whose values are looked up; those beyond are computed by the same rule.
_PLACES = 64
_SAME = np.arange(256, dtype=np.int64)
_FOLDED = _SAME.copy()
_FOLDED[65:91] = _SAME[97:123]


def _values(code: np.ndarray) -> np.ndarray:
    """Value of every 256 * place + byte."""
    return _mix((code.astype(U) + U(1)) * _GOLDEN)


_TABLE = _values(np.arange(256 * _PLACES))
#: kind -> (word bytes, the byte each one counts as). "letters": lower-cased [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; "spaced": [^\x20\x09-\x0D]+ unchanged.
KINDS = {"letters": (_LETTER_WORD, _FOLDED), "spaced": (_SPACE_WORD, _SAME)}


class Words(NamedTuple):
    """Of some rows: the words' hashes, their rows, byte ranges in data, and where each row's words start."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _piece(data: np.ndarray, offsets: np.ndarray, kind: str, base: int):
    is_word, same = KINDS[kind]
    n = len(data)
    w = is_word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[:1] = False
    before[1:] = w[:-1]
    after[-1:] = False
    after[:-1] = w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    code = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    far = np.flatnonzero(code >= _PLACES)
    code *= 256
    code += same[data[w]]
    value = np.take(_TABLE, code, mode="clip")
    value[far] = _values(code[far])
    sums = np.add.reduceat(value, first) if len(first) else np.zeros(0, U)
    hashes = _mix(sums + lengths.astype(U) * _GOLDEN)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows.astype(np.int64), starts + base, ends + base


def words_of(column: pa.Array, kind: str) -> Words:
    """All words of a column; bytes are taken in pieces of whole rows so that scratch arrays stay small."""
    data, offsets = raw(column)
    n, parts, at = len(offsets) - 1, [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        if offsets[to] > offsets[at]:
            h, r, s, e = _piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], kind, int(offsets[at]))
            parts.append((h, r + at, s, e))
        at = to
    if parts:
        hashes, rows, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, (rows, starts, ends) = np.zeros(0, U), (np.zeros(0, np.int64) for _ in range(3))
    return Words(hashes, rows, starts, ends, np.searchsorted(rows, np.arange(n + 1)), data)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size consecutive words, over row borders too: see whole()."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U)
    have, width, out, done = hashes, 1, None, 0
    while True:
        if size & width:  # the run is made of parts whose lengths are powers of two, the shortest first
            out = have if out is None else _joined(out, have[done:])
            done += width
        if done == size:
            return _mix(out[: n - size + 1] + U(size))
        have, width = _joined(have, have[width:]), 2 * width


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    n = min(len(left), len(right))
    return _mix(left[:n] * _GOLDEN + right[:n])


def whole(rows: np.ndarray, size: int) -> np.ndarray:
    """Which of these runs lie in one row."""
    return rows[size - 1 :] == rows[: len(rows) - size + 1] if len(rows) >= size else np.zeros(0, bool)


def release() -> None:
    """Gives freed memory back to the system, so that a reused worker does not keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def batches(column: pa.Array, most: int):
    """(from, to) row ranges of about most bytes of text each."""
    _, offsets = raw(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [begin, end)."""
    edge = np.bincount(begin, minlength=n + 1).astype(np.int64)
    edge -= np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
