"""Near-duplicate documents by BagMinHash signatures (weighted Jaccard).

A document is the multiset of its five-word shingles; two documents are linked
if the weighted Jaccard similarity of their multisets, sum of minima over sum
of maxima, is at least 0.8.  Steps:

1. Every text gets two 64-bit hashes; rows of equal texts collapse to the
   smallest id by a partial aggregate, so a hot group of copies costs a row per task.
2. Texts get a BagMinHash signature (Ertl 2018): the weight axis of a shingle
   is cut into dyadic intervals, each with a Poisson process whose points fall
   to random signature slots; where in its interval a point lies is settled by
   halving the interval, and a point goes as soon as its half begins above the
   shingle's weight.  Each slot keeps its first point, so P(slots equal) is the
   similarity.  Points past the last slot's first point need not be drawn: they
   are drawn up to a horizon, which is moved on only while a slot is free.
3. The signature is banded; texts that share a band meet the smallest node of
   the bucket, its centre, not each other.
4. Each member is compared with its centre exactly, as a stream: what is held is
   the centre and a batch.  Members of one centre are dealt to several tasks by
   their bytes, so the work is linear in them however large the group.
5. Links so far become components.  Inside a group only members whose component
   is not their centre's are still open.  They are compared with the members of
   other components, block by block; as 1 - similarity is a metric, a member
   whose similarity to the centre differs by more than 1 - threshold is no
   candidate.  No link is lost: every two members of a bucket are compared,
   or known to be of one class, or known to be too far apart.
6. The further links join the components.

With 24 bands of 5 rows a pair at exactly 0.8 shares no bucket with
probability 7e-5, and one at 0.9 with 1e-9.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm._store import discard, fresh, settle
from gaugeworks.llm._words import Words, mix, ranges, slices, tidy, window_hashes
from gaugeworks.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 256


def shingle_bags(column, width: int = SHINGLE) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Per text its distinct shingles, sorted, and how often each occurs.  A text of fewer words is one shingle; without words it has none."""
    words = Words(column)
    first, found = words.windows(width, salt=width)
    ends = np.searchsorted(first, words.bounds)
    bags = []
    for i, n in enumerate(words.counts.tolist()):
        h = found[ends[i] : ends[i + 1]]
        if 0 < n < width:
            h = window_hashes(words.hashes[words.bounds[i] : words.bounds[i + 1]], n, salt=n)
        h = np.sort(h)
        new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        at = np.flatnonzero(new)
        bags.append((h[at], np.diff(np.append(at, len(h)))))
    return words, bags


def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1], from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _below(point: np.ndarray, h: np.ndarray, where: np.ndarray, low: np.ndarray, size: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points that lie below their shingle's weight: a bit of the hash for each halving of the interval decides."""
    begin, half, level = low[where], size[where] >> 1, 20
    while len(half) and half.any():
        begin = begin + half * ((h >> np.uint64(level)) & np.uint64(1)).astype(np.int64)
        held = begin < bound[where]
        point, h, where, begin, half = point[held], h[held], where[held], begin[held], half[held] >> 1
        level += 1
    return point, h, where


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures, ``docs`` x ``slots`` of uint64, of weighted sets given flat.

    ``doc`` is the row of each element, ``weight`` a positive integer.  Points
    are drawn up to a horizon at which a document of that total weight has very
    likely filled all slots; where a slot is still free the horizon doubles.
    The points do not depend on the horizon, so neither does the signature.
    A document without elements has a signature of zeros.
    """
    first = np.full(docs * slots, np.inf)
    ident = np.zeros(docs * slots, np.uint64)
    total = np.bincount(doc, weights=weight, minlength=docs)
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # intervals [0,1), [1,2), [2,4), ... that begin below the weight
    row = np.repeat(np.arange(len(doc)), levels)
    level = ranges(np.zeros(len(doc), np.int64), levels)
    size = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    base = mix(element[row] ^ mix(level.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    of, bound, low = doc[row], weight[row], np.where(level == 0, 0, size)
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(docs)
    horizon[todo] = (math.log(slots) + 4.0) / total[todo]
    while len(todo):
        open_docs = np.zeros(docs, bool)
        open_docs[todo] = True
        at = np.flatnonzero(open_docs[of])
        start, step, width = np.zeros(len(at)), 0, 1
        while len(at):
            count = np.arange(step, step + width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = mix(base[at][:, None] + count[None, :])
            x = start[:, None] + np.cumsum(-np.log(_uniform(h)), axis=1) / (slots * size[at])[:, None]
            inside = x <= horizon[of[at]][:, None]
            h2 = mix(h[inside] ^ np.uint64(0xD6E8FEB86659FD93))
            where = np.broadcast_to(at[:, None], inside.shape)[inside]
            point, h2, where = _below(x[inside], h2, where, low, size, bound)
            slot = of[where] * slots + (mix(h2) >> np.uint64(33)).astype(np.int64) % slots
            name = h2
            np.minimum.at(first, slot, point)
            won = first[slot] == point
            ident[slot[won]] = name[won]
            go = inside[:, -1]
            at, start, step = at[go], x[go, -1], step + width
            width = int(np.clip(np.mean((horizon[of[at]] - start) * size[at]) * slots + 1, 1, 16)) if len(at) else 1
        free = np.isinf(first.reshape(docs, slots)).any(axis=1)
        todo = todo[free[todo]]
        horizon[todo] *= 2
    return ident.reshape(docs, slots)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key.view(np.int64)


def _signer(bands: int, rows: int, width: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                words, bags = shingle_bags(batch.column("text"), width)
                sizes = np.array([len(b[0]) for b in bags], np.int64)
                doc = np.repeat(np.arange(len(bags)), sizes)
                keys = _band_keys(bag_minhash(doc, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags), bands * rows), bands, rows)
                offsets = np.arange(len(bags) + 1, dtype=np.int32) * bands
                columns = [batch.column("id"), batch.column("h1"), batch.column("h2"), pa.array(sizes), pa.array(np.diff(words.offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "h2", "n_shingles", "n_bytes", "bands"])

    return run


def occurrences(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a sorted set: the t-th occurrence of a shingle is an element of its own, so sum of minima is size of intersection."""
    shingle, count = bag
    nth = ranges(np.zeros(len(count), np.int64), count).astype(np.uint64)
    return np.sort(mix(np.repeat(shingle, count) + nth * np.uint64(0x9FB21C651E98DF25)))


def _overlaps(column: np.ndarray, bound: np.ndarray, df: np.ndarray, rows: np.ndarray, cells: int = 1 << 22):
    """For blocks of ``rows``: the block, and how many columns each of its rows shares with every row.

    Columns that an eighth of the rows hold go through a dense product, others through their lists of rows.
    """
    n = len(bound) - 1
    owner = np.repeat(np.arange(n), np.diff(bound))
    often = df >= max(8, n // 8)
    dense = np.cumsum(often) - 1
    order = np.argsort(column, kind="stable")
    listed, begin = owner[order], np.concatenate(([0], np.cumsum(df)))
    wide, step = int(often.sum()), max(64, cells // n)
    held = often[column]
    at_row, at_col = owner[held], dense[column[held]]
    for first in range(0, len(rows), 256):
        block = rows[first : first + 256]
        out = np.zeros((len(block), n), np.float32)
        for i, x in enumerate(block.tolist()):
            own = column[bound[x] : bound[x + 1]]
            own = own[~often[own] & (df[own] > 1)]
            if len(own):
                out[i] = np.bincount(listed[ranges(begin[own], df[own])], minlength=n)
        for low in range(0, wide, step):
            part = (at_col >= low) & (at_col < low + step)
            matrix = np.zeros((n, min(step, wide - low)), np.float32)
            matrix[at_row[part], at_col[part] - low] = 1
            out += matrix[block] @ matrix.T
        yield block, out


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _to_centre(width: int):
    """Rows sorted by centre and block, the centre's own text first: each other row's similarity to it."""

    def run(batches):
        mid = np.empty(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                _, bags = shingle_bags(batch.column("text"), width)
                first = np.array(batch.column("lead").to_pylist(), bool)
                near = np.zeros(len(bags))
                for i, bag in enumerate(bags):
                    own = occurrences(bag)
                    if first[i]:
                        mid = own
                    else:
                        near[i] = _similarity(mid, own)
                yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("node"), batch.column("n_bytes"), pa.array(near)], ["centre", "node", "n_bytes", "near"]).filter(pa.array(~first))

    return run


def link_sets(sets: list[np.ndarray], left: np.ndarray, near: np.ndarray, root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of places, one of them in ``left``, of different roots that are linked; ``near`` is the similarity to a common centre."""
    size = np.array([len(x) for x in sets], np.int64)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bound = np.concatenate(([0], np.cumsum(size)))
    shared = np.add.reduceat(np.append(df[column] > 1, False).astype(np.int64), np.minimum(bound[:-1], len(column)))
    rows = left[shared[left] >= threshold * size[left]]  # elements that no other set has may not exceed the share that a link allows
    out = []
    for block, both in _overlaps(column, bound, df, rows) if len(rows) else ():
        hit = both >= threshold * (size[block][:, None] + size[None, :] - both)
        hit &= (both > 0) & (root[block][:, None] != root[None, :]) & (np.abs(near[block][:, None] - near[None, :]) <= 1 - threshold + 1e-9)
        out += [(int(block[i]), int(j)) for i, j in zip(*np.nonzero(hit), strict=True)]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linker(threshold: float, width: int):
    def run(table: pa.Table) -> pa.Table:
        first = np.array(table.column("first").to_pylist(), bool)
        if not first.any() or first.all():
            return _LINKS.empty_table()
        _, bags = shingle_bags(table.column("text"), width)
        root, near = table.column("root").to_numpy(), table.column("near").to_numpy()
        found = link_sets([occurrences(b) for b in bags], np.flatnonzero(first), near, root, threshold)
        pairs = np.unique(np.array([(root[i], root[j]) for i, j in found], np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=_LINKS)

    return run


MOST_CLASHES, MOST_BROADCAST = 10_000, 200_000


def _few(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast if it is counted to be small: then a hot centre's members need not meet in one task."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _node(clashes: list[int]) -> Column:
    """The number of a text: its first hash, or both together where that one is not unique."""
    return F.when(F.col("h1").isin(clashes), F.xxhash64("h2", "h1")).otherwise(F.col("h1")) if clashes else F.col("h1")


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _classes(own: DataFrame, threshold: float, width: int, bands: int, rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows ``(id, h1, h2, n_shingles)``, and a row per different text with shingles: ``(h1, h2, id, class_id)``."""
    signed = settle(own.mapInArrow(tidy(_signer(bands, rows, width)), "id long, h1 long, h2 long, n_shingles long, n_bytes long, bands array<long>"), "signed")
    full = signed.where("n_shingles > 0 and id is not null")
    reps = stored = settle(full.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands")), "reps")
    # two texts with one first hash: some n^2 / 2^65, none below 10^9 texts
    clashes = [r[0] for r in reps.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many texts for 64-bit numbers")
    reps = reps.withColumn("node", _node(clashes))
    banded = reps.select("node", "n_bytes", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = settle(banded.join(buckets, ["band", "key"]).where("node <> centre").select("centre", "node", "n_bytes").distinct(), "met")
    wanted = met.select("node").union(met.select("centre")).distinct()
    which = reps.join(wanted, "node", "left_semi").select("h1", "h2", "id")
    texts = settle(own.where("id is not null").join(which, ["h1", "h2", "id"], "left_semi").select(_node(clashes).alias("node"), "text").dropDuplicates(["node"]), "texts")
    blocks = met.groupBy("centre").agg(F.greatest(F.ceil(F.sum("n_bytes") / F.lit(float(block_bytes))), F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS)))).cast("int").alias("n_blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")
    lead = blocks.select("centre", F.col("centre").alias("node"), F.lit(0).cast("long").alias("n_bytes"), upto("n_blocks").alias("block"), F.lit(True).alias("lead"))
    large = settle(blocks.where("n_blocks > 1"), "large")
    tasks = met.join(_few(large), "centre", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).select("centre", "node", "n_bytes", spot("n_blocks").alias("block"), F.lit(False).alias("lead")).unionByName(lead)
    tasks = tasks.join(texts, "node").repartition("centre", "block").sortWithinPartitions("centre", "block", F.desc("lead"))
    pairs = settle(tasks.mapInArrow(tidy(_to_centre(width)), "centre long, node long, n_bytes long, near double"), "pairs")
    roots = components(pairs.where(F.col("near") >= threshold).select(F.col("centre").alias("a"), F.col("node").alias("b")))
    # what is still open: members that are not of their centre's component
    of_node, of_centre = roots.select("node", F.col("root").alias("rn")), roots.select(F.col("node").alias("centre"), F.col("root").alias("rc"))
    known = pairs.join(of_node, "node", "left").join(of_centre, "centre", "left").select("centre", "node", "n_bytes", "near", F.coalesce("rn", "node").alias("root"), (F.coalesce("rn", "node") != F.coalesce("rc", "centre")).alias("open"))
    known = settle(known, "open")
    reach = F.when(F.col("open"), F.col("near"))
    groups = known.groupBy("centre").agg(F.min(reach).alias("low"), F.max(reach).alias("high"), F.count("*").alias("n")).where("low is not null and n > 1").drop("n")
    groups, apart = settle(groups, "groups"), 1 - threshold + 1e-9
    left = known.join(_few(groups), "centre").where(F.col("open") | (F.col("near") >= F.col("low") - apart) & (F.col("near") <= F.col("high") + apart)).drop("low", "high")
    load = left.groupBy("centre").agg(F.ceil(F.sum("n_bytes") / F.lit(float(block_bytes))).cast("int").alias("n_blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    load = settle(load, "load")
    left = left.join(_few(load), "centre")
    columns = ["centre", "i", "j", "first", "node", "near", "root"]
    one = left.where("open").withColumns({"i": spot("n_blocks"), "j": upto("n_blocks"), "first": F.lit(True)}).select(columns)
    two = left.withColumns({"j": spot("n_blocks"), "i": upto("n_blocks"), "first": F.lit(False)}).select(columns)
    more = settle(one.unionByName(two).join(texts, "node").groupBy("centre", "i", "j").applyInArrow(_linker(threshold, width), "a long, b long"), "more")
    merged = components(more)
    joined = merged.select(F.col("node").alias("root"), F.col("root").alias("last"))
    labels = reps.select("h1", "h2", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(joined, "root", "left")
    labels = settle(labels.select("h1", "h2", "id", F.coalesce("last", "root").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("id").alias("class_id"))
    # a table of its own, so that joins with it are between plain exchanges and a hot text is split
    classes = settle(labels.join(least, "label").select("h1", "h2", "id", "class_id"), "classes")
    discard(stored, met, texts, large, pairs, roots, known, groups, load, more, merged, labels)
    return signed, classes


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: ``id``, ``class_id`` and ``kept``.

    Texts are linked, not ids: ``class_id`` is the smallest id of the texts that
    links reach from the row's text, its own rows included, so rows of one id
    with different texts may be in different classes.  ``kept`` holds where
    ``class_id`` equals the id.  Words are as written.  Empty and null texts
    have no shingles and link with nothing, not even each other; texts under
    ``width`` words are one shingle of all their words.  Rows with a null id
    come out in a class of their own with ``class_id`` null and ``kept`` true.
    Other columns of ``df`` are not read.
    """
    signed, classes = _classes(_hashed(df, id_col, text_col), threshold, width, bands, rows, block_bytes)
    alone = signed.where("n_shingles = 0 or id is null").select("id", F.col("id").alias("class_id"))
    full = signed.where("n_shingles > 0 and id is not null").select("id", "h1", "h2")
    out = full.join(classes.select("h1", "h2", "class_id"), ["h1", "h2"]).select("id", "class_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, one for each class: that of the smallest id (of several rows with this id, the least by text hash and then by all columns).

    Rows without words or without an id all stay.
    """
    _, classes = _classes(_hashed(df, id_col, text_col), threshold, width, bands, rows, block_bytes)
    one = classes.where("id = class_id").groupBy("class_id").agg(F.min(F.struct("h1", "h2")).alias("h"))
    text, key = F.col(text_col).cast("string"), F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col).cast("string")).alias("h2"))
    mark, rank = fresh(df, "key"), fresh(df, "rank")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col(id_col).isNotNull()
    wanted = one.select(F.struct(F.col("class_id").alias("id"), "h.h1", "h.h2").alias(mark))
    order = Window.partitionBy(mark).orderBy(*[c for c in df.columns if c not in (id_col, text_col)] or [F.lit(0)])
    some = df.where(worded).withColumn(mark, key).join(wanted, mark, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return some.select(*df.columns).unionByName(df.where(~worded))
