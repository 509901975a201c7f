"""Compact forms of what chunks of documents and hash ranges send each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray, width: int) -> bytes:
    """The low width bytes of 64-bit values, one byte plane after another: sorted values compress well so."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(body: bytes, width: int) -> np.ndarray:
    n = len(body) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def slices(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Borders of the parts, which are ranges of the hash."""
    p = ((sorted_hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(p, np.arange(parts + 1, dtype=np.uint64))


def table_of(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])
