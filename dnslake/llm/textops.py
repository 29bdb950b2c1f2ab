"""Whole-batch text helpers for Arrow batches: words, hashes and windows as numpy arrays.

A batch of texts is seen as one byte array with row offsets.  Word hashes are sums over blocks of eight bytes, each
mixed with its place first, so that no rearrangement of bytes leaves a hash unchanged; window hashes are polynomial sums
over word hashes from running sums.  Each costs a few numpy passes over the batch whatever the number of words.  Batches are cut into slices of bounded bytes
(one row at least), so memory does not depend on the number of rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_POWERS: dict[int, np.ndarray] = {}
#: Running sums go over blocks of 2**_BITS elements.
_BITS = 16


def lut_alnum_lower() -> np.ndarray:
    """Byte table for words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: 0 outside words."""
    table = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return table


def lut_blank_separated() -> np.ndarray:
    """Byte table for words of ``[^\\x20\\x09-\\x0D]``, unchanged: 0 outside words.

    NUL is a word byte; it is given the unused byte value 0xFF (never part of UTF-8)."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, 1024), base, _U)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=_U)
    return have[: n + 1]


def powers_at(base: int, exponent: np.ndarray) -> np.ndarray:
    """base**exponent modulo 2**64, from two short tables."""
    top = int(exponent.max(initial=0)) >> _BITS
    high = powers(pow(base, 1 << _BITS, 1 << 64), top)
    return powers(base, 1 << _BITS)[exponent & ((1 << _BITS) - 1)] * high[exponent >> _BITS]


def sums_at(code: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """sum of code[j] * base**j over j < i modulo 2**64, for the ascending positions i of ``at``.

    Runs over blocks, so that its memory does not grow with the text."""
    block, out = 1 << _BITS, np.zeros(len(at), _U)
    power, carry, scale = powers(base, block), 0, 1
    edges = np.searchsorted(at, np.arange(0, len(code) + block, block))
    for k, start in enumerate(range(0, len(code), block)):
        part = code[start: start + block].astype(_U) * power[: min(block, len(code) - start)]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(part, out=total[1:])
        last = start + block >= len(code)
        mine = slice(edges[k], len(at) if last else edges[k + 1])
        out[mine] = _U(carry) + _U(scale) * total[at[mine] - start]
        carry = carry + scale * int(total[-1]) & (1 << 64) - 1
        scale = scale * int(power[block]) & (1 << 64) - 1
    return out


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls (null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets of the rows."""
    text = as_strings(column)
    n = len(text)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, np.int64)[text.offset: text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges whose texts have at most ``limit`` bytes (one row at least)."""
    _, offs = flat(batch.column(batch.schema.get_field_index(column)))
    n, start = len(offs) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a slice: byte ranges, row numbers, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray, lane: int = 0):
        code = table[data]
        mask = code != 0
        n = len(data)
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        inside = offs[(offs > 0) & (offs < n)]
        first[inside] = mask[inside]
        last = mask.copy()
        last[:-1] &= ~mask[1:]
        last[inside - 1] = mask[inside - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.counts = np.diff(np.searchsorted(self.starts, offs))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(offs) - 1), self.counts)
        self.data, self.offs = data, offs
        self.hash = block_hashes(code, self.starts, self.ends, lane)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, size: int, lane: int = 0, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of ``size`` words inside one row (or of those at ``at``), and its hash."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        if at is None:
            at = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1:])
        base = _WORD_BASE + 2 * lane * 0x8CB92BA72F3D8DD7 & (1 << 64) - 1 | 1
        total = sums_at(self.hash, base, np.arange(n + 1))
        return at, mix((total[at + size] - total[at]) * powers_at(inverse(base), at) + _U(size))


def block_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of every range of bytes: blocks of eight bytes, mixed with their number in the range and summed."""
    if not len(starts):
        return np.zeros(0, _U)
    length = ends - starts
    blocks = (length + 7) >> 3
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * number
    padded = np.concatenate([code, np.zeros(8, np.uint8)])
    value = np.ndarray((len(code) + 1,), "<u8", padded, strides=(1,))[at]
    short = np.minimum(np.repeat(ends, blocks) - at, 8).astype(_U)
    value = (value << (_U(64) - _U(8) * short)) >> (_U(64) - _U(8) * short)
    place = mix(number.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((2 * lane + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    return mix(np.add.reduceat(mix(value ^ place), first) + length.astype(_U) * _U(0xD6E8FEB86659FD93))


def row_hashes(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of the sequence of codes of every row, each code mixed with its place; 0 for rows without codes."""
    out, full = np.zeros(len(counts), _U), np.flatnonzero(counts)
    if len(full):
        first = np.cumsum(counts) - counts
        place = mix((np.arange(len(codes)) - np.repeat(first, counts)).astype(_U) + _U(0xA24BAED4963EE407))
        total = np.add.reduceat(mix(codes ^ place), first[full])
        out[full] = mix(total + counts[full].astype(_U)) | _U(1)
    return out


def range_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of every range of ``code``; starts and ends ascend."""
    total = sums_at(code, base, ends) - sums_at(code, base, starts)
    return mix(total * powers_at(inverse(base), starts) + (ends - starts).astype(_U))


def cover(first: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window; windows begin at ``first`` and never leave their row."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + size, -1)
    return np.cumsum(delta[:n]) > 0


def code_point_offsets(data: np.ndarray, offs: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Code-point positions inside their rows of byte positions ``at``."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[at] - lead[offs[row]]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges values[start : start + length], one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    begin = np.cumsum(lengths) - lengths
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - begin, lengths)
    return values[index]
