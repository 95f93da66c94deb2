"""Words, word hashes and word windows as flat numpy arrays (executor side).

A word is a maximal run of bytes other than ASCII white space, that is
``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` cuts exactly there.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_SPAN = 1 << 18


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(_SPAN + 1, base, np.uint64)
    down = np.full(_SPAN + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


#: For each of two polynomials: a value for each byte, the powers of its base and of the base's inverse modulo 2^64.
_POLYNOMIALS = [(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(step)), *_powers(base)) for step, base in ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5))]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order and do not overlap."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(out):
        begin = int(start[at])
        to = int(np.searchsorted(end, begin + _SPAN, "right"))
        if to == at:
            out[at] = xxhash.xxh3_64_intdigest(data[begin : end[at]].tobytes())
            at += 1
            continue
        part = data[begin : int(end[to - 1])]
        i, j = start[at:to] - begin, end[at:to] - begin
        value = (j - i).astype(np.uint64)
        for byte, up, down in _POLYNOMIALS:
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(byte[part] * up[: len(part)], out=sums[1:])
            value = mix(value + (sums[j] - sums[i]) * down[i])
        out[at:to] = value
        at = to
    return out


class Words:
    """The words of a column of texts.

    ``hashes`` has one 64-bit value per word, ``start`` and ``end`` its bytes
    in ``data``, ``bounds`` the first word of each text and the end.
    """

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        low, high = int(self.offsets[0]), int(self.offsets[-1])
        self.offsets = self.offsets - low
        self.data = np.frombuffer(data, np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        n = high - low
        if not n:
            self.start = self.end = np.empty(0, np.int64)
        else:
            inside = ~_SPACE[self.data]
            before = np.concatenate(([False], inside[:-1]))
            before[self.offsets[:-1][self.offsets[:-1] < n]] = False
            after = np.concatenate((inside[1:], [False]))
            after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
            self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.bounds)
        self.hashes = span_hashes(self.data, self.start, self.end)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of ``width`` words inside one text, and the run's hash."""
        at = ranges(self.bounds[:-1], np.maximum(self.counts - width + 1, 0))
        return at, window_hashes(self.hashes, width, salt)[at] if len(at) else np.empty(0, np.uint64)

    def join(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a text, or those where ``keep`` (per word of the column) holds, joined by one space."""
        i, j = self.bounds[text], self.bounds[text + 1]
        start, end = self.start[i:j], self.end[i:j]
        if keep is not None:
            start, end = start[keep[i:j]], end[keep[i:j]]
        if not len(start):
            return b""
        size = end - start + 1
        out = self.data[np.minimum(ranges(start, size), len(self.data) - 1)]
        out[np.cumsum(size) - 1] = 32
        return out[:-1].tobytes()


def window_hashes(word_hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of ``width`` words; as many fewer than words as ``width - 1``."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64((0x9E3779B97F4A7C15 + 2 * salt * 0xD1342543DE82EF95) & MASK | 1)
    out = word_hashes[:n].copy()
    for k in range(1, width):
        out *= factor
        out += word_hashes[k : k + n]
    return mix(out ^ np.uint64((salt * 0xA0761D6478BD642F) & MASK))


def texts_of(column) -> list[bytes]:
    """UTF-8 of each text; null gives empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Consecutive parts of a batch, each with ``most`` bytes in ``column`` or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, total = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            ends.append(i)
            start, total = i, 0
        total += n
    start = 0
    for end in [*ends, batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end


def release() -> None:
    """Gives freed memory back to the system: Python workers stay between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def tidy(run):
    """``run`` for ``mapInArrow``, releasing memory when its task ends.

    Where the session leaves the size of Arrow batches at Spark's default (64
    MB, which both sides of a task hold several times), it is set to 4 MB.
    """
    session = SparkSession.getActiveSession()
    if session is not None and not session.sparkContext.getConf().contains(BATCHES) and session.conf.get(BATCHES) == f"{64 << 20}b":
        session.conf.set(BATCHES, str(BATCH_BYTES))

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift
