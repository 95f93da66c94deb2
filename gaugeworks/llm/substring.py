"""Removal of word runs that an earlier document holds too, by difference-cover anchors.

A window is ``width`` (13) consecutive words.  Every word covered by a window
whose words also begin somewhere in a document with a smaller id is removed;
windows are judged on the input.

With the difference cover {0, 1, 3} modulo 7, any two positions can be shifted
together by less than 7 so that both land on cover positions.  So two equal
13-word windows hold an equal 7-word anchor that begins, in both, at a cover
position of its document, and hashing anchors at 3 positions of 7 misses no
match.  Three exchanges, all of packed arrays:

1. documents are dealt by a hash of id and text into batches of bounded bytes; a
   batch sends each of its distinct anchors once, 6 bytes each, to a bucket of
   the hash range, and gets back one bit each: does another batch have it?
2. a batch extends shared anchors to whole windows and sends each distinct one
   once with its smallest document, and gets back those that a smaller document
   elsewhere holds;
3. the batch marks the covered words.

A passage that a third of all documents hold is one entry per batch, so no
bucket and no batch grows with a hot passage; rows of one id, or without one,
are spread by their texts, and equal rows by the input partitions they are in.

Rows between batches and buckets number batches times buckets, which grows with
the square of the input while both have a fixed size.  So the sizes are derived
from the input: they grow with its root, eightfold at most (:func:`sizes`).

Windows are equal if 64 bits of their hash and the bits of their bucket, which
are of another hash, are: with n windows that share an anchor in b buckets some
n^2 / (b 2^65) pairs are taken for equal wrongly, 0.001 at 10^9 windows in 1,000
buckets.  Anchors only choose candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._store import text_bytes
from gaugeworks.llm._words import Words, mix

WIDTH, PERIOD, COVER = 13, 7, (0, 1, 3)
BATCH_BYTES, BUCKET_ENTRIES, USUAL_BYTES, MOST_TIMES = 8 << 20, 2 << 20, 32 << 30, 8
LAST = np.iinfo(np.int64).max


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the hash, so that sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def sizes(total: int) -> tuple[int, int]:
    """Bytes of a batch and entries of a bucket for an input of ``total`` bytes of text."""
    times = min(MOST_TIMES, max(1.0, (total / USUAL_BYTES) ** 0.5))
    return int(BATCH_BYTES * times), int(BUCKET_ENTRIES * times)


class _Batch:
    def __init__(self, table: pa.Table, width: int, period: int, cover: tuple[int, ...]):
        self.ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        self.words = Words(table.column("text"))
        self.width, self.period, self.cover = width, period, cover
        self.owner = self.words.owner()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each anchor: at cover positions of texts that have a window at all."""
        length = self.width - self.period + 1
        at, h = self.words.windows(length)
        text = self.owner[at]
        held = np.isin((at - self.words.bounds[text]) % self.period, self.cover) & (self.words.counts[text] >= self.width)
        return at[held], h[held]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each window, its hash, and another hash that deals it to a bucket."""
        at, h = self.words.windows(self.width, salt=1)
        _, deal = self.words.windows(self.width, salt=2)
        return at, h, deal


def _send(key: int, bucket: np.ndarray, **arrays: np.ndarray) -> dict[str, list]:
    """Rows (bucket, key, one packed value per array); ``bucket`` is sorted."""
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)])
    ends = np.append(cuts[1:], len(bucket))[: len(cuts)]
    out = {"bucket": bucket[cuts].astype(np.int32), "batch": np.full(len(cuts), key, np.int32)}
    for name, values in arrays.items():
        out[name] = [values[i:j].tobytes() for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return out


_ANCHORS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("packed", pa.binary())])
_WINDOWS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("packed", pa.binary()), ("owner", pa.binary())])
_KEPT = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _anchor_sender(shape, buckets):
    def run(table: pa.Table) -> pa.Table:
        _, h = _Batch(table, *shape).anchors()
        h = np.unique(h)
        low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        return pa.table(_send(table.column("batch")[0].as_py(), _bucket(h, buckets), packed=low), schema=_ANCHORS)

    return run


def _low48(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.view("<u8").reshape(-1)


def _anchor_judge(table: pa.Table) -> pa.Table:
    sent = [_low48(x) for x in table.column("packed").to_pylist()]
    found, times = np.unique(np.concatenate(sent), return_counts=True)
    shared = found[times > 1]
    answer = []
    for values in sent:
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        answer.append(np.packbits(shared[at] == values).tobytes() if len(shared) else b"")
    return table.set_column(2, pa.field("packed", pa.binary()), pa.array(answer, pa.binary())).cast(_ANCHORS)


def _window_sender(shape, buckets):
    width, period, _ = shape

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _WINDOWS.empty_table()
        batch = _Batch(left, *shape)
        at, h = batch.anchors()
        found, which = np.unique(h, return_inverse=True)
        owner = batch.owner[at]
        low, high = np.full(len(found), len(batch.ids)), np.full(len(found), -1)
        np.minimum.at(low, which, owner)
        np.maximum.at(high, which, owner)
        shared = low < high  # in two texts of this batch
        bucket = _bucket(found, buckets)
        for b, bits in zip(right.column("bucket").to_pylist(), right.column("packed").to_pylist(), strict=True):
            if bits:
                i, j = np.searchsorted(bucket, [b, b + 1])
                shared[i:j] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
        marks = np.zeros(len(batch.words.hashes) + 1, np.int64)
        marks[at[shared[which]] + 1] = 1
        marks = np.cumsum(marks)
        at, h, deal = batch.windows()
        held = marks[at + period] > marks[at]  # an anchor begins at one of the window's first words
        at, h, deal = at[held], h[held], deal[held]
        ids = batch.ids[batch.owner[at]]
        order = np.lexsort((ids, h))
        h, ids, deal = h[order], ids[order], deal[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        h, ids, deal = h[new], ids[new], _bucket(mix(deal[new]), buckets)
        order = np.argsort(deal, kind="stable")
        return pa.table(_send(left.column("batch")[0].as_py(), deal[order], packed=h[order], owner=ids[order]), schema=_WINDOWS)

    return run


def _window_judge(table: pa.Table) -> pa.Table:
    """Of each batch's windows, those that another batch has in a smaller document."""
    sent = [np.frombuffer(x, np.uint64) for x in table.column("packed").to_pylist()]
    h, ids = np.concatenate(sent), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owner").to_pylist()])
    found, which = np.unique(h, return_inverse=True)
    least = np.full(len(found), LAST)
    np.minimum.at(least, which, ids)
    gone, out, i = least[which] < ids, [], 0
    for values in sent:
        out.append(values[gone[i : i + len(values)]].tobytes())
        i += len(values)
    return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "packed": pa.array(out, pa.binary())}, schema=_ANCHORS)


def _remover(shape):
    width = shape[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _KEPT.empty_table()
        batch = _Batch(left, *shape)
        words = batch.words
        at, h, _ = batch.windows()
        ids = batch.ids[batch.owner[at]]
        found, which = np.unique(h, return_inverse=True)
        least = np.full(len(found), LAST)
        np.minimum.at(least, which, ids)
        if right.num_rows:
            outside = np.frombuffer(b"".join(right.column("packed").to_pylist()), np.uint64)
            least[np.isin(found, outside)] = np.iinfo(np.int64).min
        start = at[ids > least[which]]
        cover = np.zeros(len(words.hashes) + 1, np.int64)
        cover[start] += 1
        cover[start + width] -= 1
        keep = np.cumsum(cover[:-1]) == 0
        kept = np.add.reduceat(np.append(keep, False).astype(np.int64), words.bounds[:-1]) * (words.counts > 0) if len(words.counts) else words.counts
        texts = [words.join(i, keep) for i in range(len(words.counts))]
        return pa.table({"id": left.column("given"), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": words.counts, "n_removed": words.counts - kept}, schema=_KEPT)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, batch_bytes: int | None = None, bucket_entries: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``id``, ``text`` (kept words joined by one space), ``n_words``, ``n_removed``.

    Null and empty texts have no words.  Rows that share an id do not take words
    from each other.  A row with a null id counts as after all others, its id
    comes out null.  Texts of fewer than ``width`` words stay whole.  Other
    columns of ``df`` are not read.  ``batch_bytes`` and ``bucket_entries`` of
    None are derived from the input.
    """
    if width < PERIOD:
        raise ValueError(f"width must be {PERIOD} at least")
    shape = (width, PERIOD, COVER)
    own = df.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(own, "text")
    batch_bytes, bucket_entries = (given or derived for given, derived in zip((batch_bytes, bucket_entries), sizes(size), strict=True))
    batches = max(1, -(-size // batch_bytes))
    buckets = max(1, -(-size // (12 * bucket_entries)))  # about 6 bytes a word, 3 anchors per 7 words
    own = own.withColumn("id", F.coalesce("given", F.lit(int(LAST)))).withColumn("batch", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(batches)).cast("int"))
    dealt = own.select("batch", "id", "given", "text").groupBy("batch")
    sent = "bucket int, batch int, packed binary"
    anchors = dealt.applyInArrow(_anchor_sender(shape, buckets), sent).groupBy("bucket").applyInArrow(_anchor_judge, sent)
    windows = dealt.cogroup(anchors.groupBy("batch")).applyInArrow(_window_sender(shape, buckets), sent + ", owner binary")
    gone = windows.groupBy("bucket").applyInArrow(_window_judge, sent)
    out = dealt.cogroup(gone.groupBy("batch")).applyInArrow(_remover(shape), "id long, text string, n_words long, n_removed long")
    return out
