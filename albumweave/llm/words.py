"""Words of whole texts as numpy arrays: bounds, 64-bit hashes, shingles. Words are runs of bytes other than
space and tab to carriage return; A-Z are lowered first. All work is vectorised over slices of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_BYTE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Slice:
    """Consecutive rows of a batch: row range, bytes, byte bounds of rows and words, word bounds of rows."""

    first: int
    last: int
    data: np.ndarray
    doc_off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lens = self.ends - self.starts
        at = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        pos = np.arange(int(at[-1] + lens[-1])) - np.repeat(at, lens)
        values = _BYTE[self.data[np.repeat(self.starts - at, lens) + np.arange(len(pos))]]
        values *= powers(_BASE, int(lens.max()))[pos]
        return mix(np.add.reduceat(values, at) + lens.astype(np.uint64))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), off


def slices(col, lower: bool = True, most: int = 1 << 20) -> Iterator[Slice]:
    """The rows in slices of about `most` bytes; one row is never cut."""
    data, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        x = (_LOWER if lower else _SAME)[data[off[i] : off[j]]]
        doc = off[i : j + 1] - off[i]
        word = ~_SEP[x]
        st, en = word.copy(), word.copy()
        st[1:] &= ~word[:-1]
        en[:-1] &= ~word[1:]
        full = doc[:-1] < doc[1:]
        a, b = doc[:-1][full], doc[1:][full] - 1
        st[a], en[b] = word[a], word[b]
        starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
        yield Slice(i, j, x, doc, starts, ends, np.searchsorted(starts, doc))
        i = j


def shingles(words: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `size` words within a row; a row with fewer words gives its whole sequence as one."""
    n, total = len(off) - 1, len(words)
    lens = np.diff(off)
    row = np.repeat(np.arange(n), lens)
    if total >= size:
        m = total - size + 1
        h = np.zeros(m, np.uint64)
        p = powers(_STEP, size)
        for k in range(size):
            h += words[k : k + m] * p[k]
        ok = row[:m] == row[size - 1 :]
        h, r = mix(h[ok]), row[:m][ok]
    else:
        h, r = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((lens > 0) & (lens < size))
    if len(short):
        whole = []
        for d in short:
            w = words[off[d] : off[d + 1]]
            whole.append((w * powers(_STEP, len(w))).sum(dtype=np.uint64))
        h = np.concatenate([h, mix((np.array(whole, np.uint64) + lens[short].astype(np.uint64) * _BASE) ^ _STEP)])
        r = np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted by row and hash."""
    if not len(h):
        return h, row
    h = h.copy()
    cut = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(h)]])
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        h[i:j].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]
