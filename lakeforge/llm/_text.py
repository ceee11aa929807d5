"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the data buffer of an Arrow string column, so that a worker
touches bytes with numpy and never loops over words in Python.  Words are runs of
bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased first where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INV = U64(pow(int(_P), -1, 1 << 64))
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _P)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_BYTE = _BYTE[_FOLD]
_POW = np.cumprod(np.concatenate([[U64(1)], np.full(_BLOCK, _P)]), dtype=U64)
_INV = np.cumprod(np.concatenate([[U64(1)], np.full(_BLOCK, _P_INV)]), dtype=U64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `most` bytes of text (always one row at least)."""
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a row's end is a word's end."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    before[first] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(word & ~after) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal (folded) bytes wherever they stand."""
    out = np.empty(len(starts), U64)
    table = _FOLDED_BYTE if fold else _BYTE
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if j == i:  # one word longer than a block
            h, scale = 0, 1
            for b in range(int(base), int(ends[i]), _BLOCK):
                part = table[raw[b : min(b + _BLOCK, int(ends[i]))]]
                h = (h + scale * int((part * _POW[: len(part)]).sum(dtype=U64))) % (1 << 64)
                scale = scale * int(_POW[_BLOCK]) % (1 << 64)
            out[i] = U64(h)
            i += 1
            continue
        piece = raw[base : ends[j - 1]]
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum(table[piece] * _POW[: len(piece)], dtype=U64, out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * _INV[s]
        i = j
    return mix(out)


def words(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word of a column, and the first word of each row (n + 1 places)."""
    raw, off = buffers(column)
    starts, ends, rows = spans(raw, off)
    first = np.searchsorted(starts, off, "left")
    return word_hashes(raw, starts, ends, fold), rows, first
