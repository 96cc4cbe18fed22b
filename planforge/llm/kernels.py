"""Vectorised numpy kernels over UTF-8 text held in Arrow buffers.

All functions work on a :class:`Chunk`: the bytes of a few documents laid end
to end plus their offsets.  Words are maximal runs of bytes outside
``{0x20, 0x09..0x0D}``; those separators are ASCII, so splitting bytes equals
splitting code points.  Hashes of short ranges are 64-bit polynomial prefix sums
over a random byte table, so that a range costs one subtraction.  Modulo 2**64
such polynomials have texts of some hundred units that collide by construction
(Thue-Morse words), so ranges of ``LONG`` units and more are digested instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 1 << 16
LONG = 64  # units from which on a range is digested

_RNG = np.random.default_rng(20240607)
_BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD6E8FEB86659FD93 | 1)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Grows tables of base**i and base**-i (mod 2**64) on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, np.uint64(_inverse(int(base)))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            up, down = np.full(m, self.base), np.full(m, self.inv)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = (_Powers(_BASE), _Powers(_BASE2))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that carries every input bit into the high bits."""
    out = h >> np.uint64(32)
    out ^= h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


@dataclass
class Chunk:
    """Rows ``first .. first+len(starts)`` of a batch; a null text is empty."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of each contiguous piece of a string column."""
    for piece in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(piece) == 0:
            continue
        if not pa.types.is_large_string(piece.type):
            piece = piece.cast(pa.large_string())
        _, offsets, data = piece.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[piece.offset : piece.offset + len(piece) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        if piece.null_count:  # a null slot may span bytes in principle: make it empty
            lengths = np.where(np.asarray(piece.is_valid()), np.diff(off), 0)
            if (np.diff(off) != lengths).any():
                piece = piece.fill_null("")
                _, offsets, data = piece.buffers()
                off = np.frombuffer(offsets, dtype=np.int64)[piece.offset : piece.offset + len(piece) + 1]
                raw = np.frombuffer(data, dtype=np.uint8)
        yield raw, off


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Cuts a string column into chunks of about ``size`` bytes of whole documents, at most ``rows`` of them."""
    row = 0
    for raw, off in text_buffers(column):
        n, i = len(off) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
            j = min(j, n, i + rows)
            yield Chunk(row + i, raw[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i])
            i = j
        row += n


@dataclass
class Words:
    """Words of a chunk in order; ``first[d]:first[d+1]`` are those of document d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(chunk: Chunk, data: np.ndarray | None = None) -> Words:
    data = chunk.data if data is None else data
    n = len(data)
    inside = ~SEPARATOR[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    borders = chunk.starts[(chunk.starts > 0) & (chunk.starts < n)]
    start[borders] |= inside[borders]
    end[borders - 1] |= inside[borders - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(s, e, np.concatenate([np.searchsorted(s, chunk.starts), [len(s)]]))


@dataclass
class Prefix:
    """Prefix sums of a sequence: ``sums[j] - sums[i]`` is the sum of term * base**position over [i, j)."""

    sums: np.ndarray
    raw: np.ndarray
    powers: _Powers
    salt: int

    def __len__(self) -> int:
        return len(self.raw)


def _prefix(terms: np.ndarray, raw: np.ndarray, salt: int) -> Prefix:
    """Overwrites ``terms``."""
    up, _ = _POWERS[salt].upto(len(terms) + 1)
    sums = np.zeros(len(terms) + 1, dtype=np.uint64)
    terms *= up[:-1]
    np.cumsum(terms, out=sums[1:])
    return Prefix(sums, np.ascontiguousarray(raw), _POWERS[salt], salt)


def byte_prefix(data: np.ndarray, salt: int = 0) -> Prefix:
    return _prefix(_BYTE_TABLE[data], data, salt)


def token_prefix(tokens: np.ndarray, salt: int = 1, raw: np.ndarray | None = None) -> Prefix:
    """As byte_prefix, over integers; ``raw``: the same sequence in fewer bytes, for digests."""
    return _prefix(mix(tokens.astype(np.uint64)), tokens if raw is None else raw, salt)


def range_hash(p: Prefix, starts: np.ndarray, ends: np.ndarray, digests: bool = True) -> np.ndarray:
    """Position-independent hash of each range, length included; two salts give independent hashes."""
    _, down = p.powers.upto(len(p.sums))
    size = ends - starts
    h = p.sums[ends]
    h -= p.sums[starts]
    h *= down[starts]
    h += size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    h = mix(h)
    if not digests:
        return h
    long = np.flatnonzero(size >= LONG)
    if len(long):
        h[long] = [xxhash.xxh3_64_intdigest(p.raw[i:j], p.salt) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def gram_hashes(p: Prefix, width: int) -> np.ndarray:
    """A hash of every range of ``width`` positions, without digests: equal ranges have equal ones."""
    n = max(0, len(p) - width + 1)
    _, down = p.powers.upto(len(p.sums))
    h = p.sums[width:] - p.sums[:n]
    h *= down[:n]
    h += np.uint64(width * 0x632BE59BD9B4E019 % (1 << 64))
    return mix(h)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return range_hash(byte_prefix(data), w.starts, w.ends)


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window of ``width`` values; len(values) - width + 1 results."""
    have, out = 1, values
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(out) - (width - have)], out[width - have :])
    return out


_LOW, _HALF = np.uint64(63), np.uint64(32)
_PLACES = np.arange(1 << 19, dtype=np.uint64) & _LOW


def minimizers(h: np.ndarray, window_ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, end of windows): the leftmost least hash of each valid window of ``width`` values.

    ``window_ok[j]`` says whether window ``[j, j+width)`` counts; width is 32 at
    most.  The low bits of the compared keys hold the place modulo 64, so that
    the minimum tells its position.  Places are numbered twice, 32 apart: a
    window wraps in one numbering at most, and the other one gives the leftmost.
    So equal windows have minima at equal places, and consecutive windows share
    theirs: each position is listed once.
    """
    n = len(h)
    if not 0 < width <= 32:
        raise ValueError("a window has 1 to 32 values")
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    place = _PLACES[:n] if n <= len(_PLACES) else np.arange(n, dtype=np.uint64) & _LOW
    high = h & ~_LOW
    least = sliding(high | place, width, np.minimum)
    shifted = sliding(high | (place ^ _HALF), width, np.minimum) ^ _HALF
    wraps = place[: len(least)] > np.uint64(64 - width)
    least[wraps] = shifted[wraps]
    ok = window_ok[: len(least)]
    at = np.arange(len(least)) + (((least & _LOW).astype(np.int64) - np.arange(len(least))) & 63)
    cut = np.ones(len(least), dtype=bool)
    np.not_equal(at[1:], at[:-1], out=cut[1:])
    cut[1:] |= ok[1:] != ok[:-1]
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(least))
    keep = ok[start]
    start, end = start[keep], end[keep]
    return at[start], start, end


def set_bits(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the union of ranges over [0, n)."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:-1] > 0
