"""Words and word windows of whole Arrow batches as numpy arrays: one pass over the bytes, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_draw = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _draw.integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(int(_draw.integers(0, 2**64, dtype=np.uint64)) | 5)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = _draw.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are handled at once.
BLOCK = 6_000_000


_LOWER_BYTE = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int, which: int) -> np.ndarray:
    """The first ``n`` powers of the step (0) or of its inverse (1), kept for the next block of a worker."""
    if len(_POWERS[which]) < n:
        power = np.full(max(n, BLOCK + 1_000_000), (_STEP, _BACK)[which], np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        if n > len(power) or n > 4 * BLOCK:
            return power[:n]
        _POWERS[which] = power
    return _POWERS[which][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``most`` bytes; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins, the end last; a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: ``start`` and ``end`` in ``data``, ``doc`` the row, ``first`` the first word of each row."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(texts)
        data = self.data
        inside = ~_SPACE[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | fresh[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(self.offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.lower = lower

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of ASCII letters in lower case, if asked for)."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER_BYTE if self.lower else _BYTE)[self.data] * powers(n, 0), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * powers(n, 1)[self.start]
        return mixed(h + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i]: self.end[i]].tobytes().decode("utf-8", "replace")


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words; runs that leave a text are the caller's to mask (see ``whole``)."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, np.uint64((0x9E3779B97F4A7C15 * (size + 64 * salt) + salt) % 2**64), np.uint64)
    for k in range(size):
        total += hashes[k: k + n] * _PLACE[(k + 29 * salt) % 64]
    return mixed(total)


def whole(doc: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words stay in one text."""
    n = max(0, len(doc) - size + 1)
    return doc[:n] == doc[size - 1: size - 1 + n]


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned numbers, byte by byte: high bytes that are mostly zero compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()
