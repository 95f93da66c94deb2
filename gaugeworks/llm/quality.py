"""Ordinal cumulative-link regression on hashed text features.

Grades are ordered: 0 toxic, 1 poor, 2 good (:func:`grades` makes them from the
two label columns).  One weight vector w over hashed features is shared by all
grades and ordered thresholds t_1 < t_2 cut its score:

    P(grade >= k) = sigmoid(w.x - t_k)

The expected grade is the sum of these over k, and the tail probability of the
highest grade selects documents.  The model is fitted on a sample of labelled
rows whose bounds are the parameters ``sample_rows`` and ``sample_bytes`` (drawn
by a hash of the id); every document is scored.

Features of a text, each hashed to ``2**bits`` weights and entering with
log(1 + count) over the length of the vector: words, the first five and the
last three characters of words, and shape counts (share of punctuation,
capitals, repeated words, a size class).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._words import Words, mix, release, slices, span_hashes, tidy

BITS, SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, TOP = 18, 6000, 32 << 20, 40, 2
#: The value of a shape feature beside the words' vector of length 1; the share of held-out good texts that the cut must pass.
SHAPE_VALUE, PASS = 4.0, 0.99


def grades(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` -> one row per id with ``grade``: 0 if toxic, else 1, or 2 if of quality.

    An id with several labels gets the lowest grade; rows with a null in any of
    the three columns are left out.
    """
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return rows.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _lower(column) -> pa.Array:
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.fill_null(""))


_SHAPES = 12


def features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, feature, value) of a column of texts, sorted by text."""
    size = np.uint64((1 << bits) - _SHAPES * 8)
    words = Words(_lower(column))
    raw = Words(column)
    n = len(words.counts)
    owner = words.owner()
    parts = [words.hashes]
    begins = np.flatnonzero((words.data & 0xC0) != 0x80)  # the first byte of each character
    first, behind = np.searchsorted(begins, words.start), np.searchsorted(begins, words.end)
    begins = np.append(begins, len(words.data))
    five, three = np.minimum(begins[np.minimum(first + 5, len(begins) - 1)], words.end), begins[np.maximum(behind - 3, first)]
    for salt, start, end in ((1, words.start, five), (2, three, words.end)):
        parts.append(mix(span_hashes(words.data, start, end) + np.uint64(salt)))
    key = np.concatenate([owner.astype(np.uint64) << np.uint64(bits) | p % size for p in parts])
    key, count = np.unique(key, return_counts=True)
    text, feature, value = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.log1p(count)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=n))
    value = value / norm[text]

    def share(of: Words, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[of.offsets[1:]] - sums[of.offsets[:-1]]) / np.maximum(np.diff(of.offsets), 1)

    byte = raw.data
    kinds = [(byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57), byte == 33, byte == 124, np.isin(byte, list(b"%&*#$")), byte == 10, np.isin(byte, list(b".,"))]
    shapes = [share(raw, k) for k in kinds]
    pair = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.hashes
    _, first = np.unique(pair, return_index=True)
    distinct = np.bincount(owner[first], minlength=n)
    again = np.concatenate(([False], (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])))[: len(owner)]
    total = np.maximum(words.counts, 1)
    shapes += [distinct / total, np.bincount(owner, weights=again, minlength=n) / total, np.log1p(words.counts) / 12, np.diff(words.offsets) / total / 40]
    where, what, much = [text], [feature], [value]
    for k, s in enumerate(shapes):
        level = np.clip((np.sqrt(np.clip(s, 0, 1)) * 8).astype(np.int64), 0, 7)  # one of eight levels
        where.append(np.arange(n))
        what.append(int(size) + k * 8 + level)
        much.append(np.full(n, SHAPE_VALUE))
    where, what, much = map(np.concatenate, (where, what, much))
    order = np.argsort(where, kind="stable")
    return where[order], what[order], much[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS
    cut: float = 0.5

    def score(self, column) -> np.ndarray:
        text, feature, value = features(column, self.bits)
        return np.bincount(text, weights=self.weights[feature].astype(np.float64) * value, minlength=len(column))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _table(texts: list[str], bits: int, least_texts: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, feature, value) for each 250 texts, in 8 bytes a feature; features of fewer than ``least_texts`` texts are left out."""
    parts, seen = [], np.zeros(1 << bits, np.int32)
    for i in range(0, len(texts), 250):
        text, feature, value = features(pa.array(texts[i : i + 250], pa.string()), bits)
        seen += np.bincount(feature, minlength=1 << bits).astype(np.int32)
        parts.append((np.bincount(text, minlength=len(texts[i : i + 250])), feature.astype(np.int32), value.astype(np.float32)))
    common, out = seen >= least_texts, []
    while parts:
        size, feature, value = parts.pop(0)
        held = common[feature]
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)[held]
        out.append((row, feature[held], value[held]))
    return out


def fit_ordinal(texts: list[str], grade: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-5, least_texts: int = 8, top: int = TOP) -> Ordinal:
    """Maximum likelihood by Adam over batches of 250 rows; the thresholds keep order as a first value and positive steps.

    Features of fewer than ``least_texts`` texts stay out: they would tell texts
    apart, not grades.  Grades weigh alike, whatever their number of rows.  The
    grades are 0 to ``top`` whether or not the rows hold them all.  With rows of
    one grade only everything gets that grade; without rows, the highest.
    """
    weights = np.zeros(1 << bits)
    kinds = np.unique(grade)
    if len(kinds) < 2:
        only = int(kinds[0]) if len(kinds) else top
        return Ordinal(weights.astype(np.float32), np.where(np.arange(1, top + 1) <= only, -6.0, 6.0) + 1e-3 * np.arange(top), bits)
    parts = _table(texts, bits, least_texts)
    each = np.bincount(grade, minlength=top + 1)
    share = len(grade) / np.maximum(each, 1) / len(kinds)  # of mean 1 over all rows
    mean, seen = np.zeros(1 << bits), np.zeros(1 << bits)
    first, steps = -3.0, np.full(top - 1, 2.0)
    mean_t, seen_t = np.zeros(top), np.zeros(top)
    step, order = 0, np.random.default_rng(0)
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for k in order.permutation(len(parts)).tolist():
            row, feature, value = parts[k]
            y = grade[250 * k : 250 * k + 250]
            rows, weight = np.arange(len(y)), share[y] / len(y)
            step += 1
            fix, fix_seen = 1 - 0.9**step, 1 - 0.99**step
            score = np.bincount(row, weights=weights[feature] * value, minlength=len(y))
            cut = first + np.concatenate(([0], np.cumsum(steps)))
            above = _sigmoid(score[:, None] - cut)  # P(grade >= k), k = 1..top
            edge = np.column_stack([np.ones(len(y)), above, np.zeros(len(y))])
            high, low = edge[rows, y], edge[rows, y + 1]
            chance = np.maximum(high - low, 1e-12)
            pull = (high * (1 - high) - low * (1 - low)) / chance * weight  # of the score
            slope = np.zeros((len(y), top))  # of each threshold
            has = y > 0
            slope[rows[has], y[has] - 1] -= (high * (1 - high) / chance * weight)[has]
            has = y < top
            slope[rows[has], y[has]] += (low * (1 - low) / chance * weight)[has]
            g = np.bincount(feature, weights=pull[row] * value, minlength=1 << bits) - decay * weights
            mean, seen = 0.9 * mean + 0.1 * g, 0.99 * seen + 0.01 * g * g
            weights += pace * (mean / fix) / (np.sqrt(seen / fix_seen) + 1e-6)
            gt = slope.sum(axis=0)
            gt = np.cumsum(gt[::-1])[::-1]  # by the first threshold and the steps above it
            mean_t, seen_t = 0.9 * mean_t + 0.1 * gt, 0.99 * seen_t + 0.01 * gt * gt
            move = pace * (mean_t / fix) / (np.sqrt(seen_t / fix_seen) + 1e-6)
            first += move[0]
            steps = np.maximum(steps + move[1:], 0.05)
    return Ordinal(weights.astype(np.float32), first + np.concatenate(([0], np.cumsum(steps))), bits)


def choose_cut(model: Ordinal, texts: list[str], grade: np.ndarray, share: float = PASS) -> float:
    """The highest tail probability that ``share`` of the texts of the highest grade reach; 0.5 without such texts."""
    top = [t for t, g in zip(texts, grade, strict=True) if g == len(model.thresholds)]
    if not top:
        return 0.5
    tail = np.concatenate([model.tails(model.score(pa.array(top[i : i + 250], pa.string())))[:, -1] for i in range(0, len(top), 250)])
    return float(np.quantile(tail, 1 - share, method="lower"))


def sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """At most ``sample_rows`` labelled texts (``text``, ``grade``) of ``sample_bytes`` UTF-8 bytes together, on the driver.

    They are the rows with the smallest hashes of their id, per grade a third of
    the bound at most, so the sample is the same however rows are stored; where
    rows share an id, its shortest text counts, and of these the least.  First
    only ids and sizes come to the driver; texts are taken in order while their
    sum is in the bound (one longer than a 64th of it never is), and those alone
    are fetched.
    """
    graded = grades(labels)
    rank = F.xxhash64(F.col("doc_id"), F.lit(7))
    kept = None
    for g in range(TOP + 1):
        part = graded.where(F.col("grade") == g).orderBy(rank, "doc_id").limit(max(1, sample_rows // (TOP + 1)))
        kept = part if kept is None else kept.unionByName(part)
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.octet_length(F.col(text_col).cast("string")).alias("size")).where(F.col("size") <= sample_bytes // 64)
    sizes = texts.drop("text").join(F.broadcast(kept), "doc_id").groupBy("doc_id", "grade").agg(F.min("size").alias("size")).orderBy(rank, "doc_id").toArrow()
    held = sizes.filter(pa.array(np.cumsum(sizes.column("size").to_numpy().astype(np.int64)) <= sample_bytes))
    chosen = F.broadcast(documents.sparkSession.createDataFrame(held)) if held.num_rows else kept.withColumn("size", F.lit(0)).limit(0)
    return texts.join(chosen, ["doc_id", "size"]).groupBy("doc_id", "grade").agg(F.min("text").alias("text")).orderBy(rank, "doc_id").select("text", "grade").toArrow()


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS) -> Ordinal:
    """Fit on :func:`sample`; a fifth of it is held out and sets the cut that selects documents."""
    rows = sample(documents, labels, id_col, text_col, sample_rows, sample_bytes)
    texts, grade = rows.column("text").to_pylist(), rows.column("grade").to_numpy().astype(np.int64)
    held = np.arange(len(texts)) % 5 == 0
    model = fit_ordinal([t for t, h in zip(texts, held, strict=True) if not h], grade[~held], bits)
    model.cut = choose_cut(model, [t for t, h in zip(texts, held, strict=True) if h], grade[held])
    del rows, texts
    release()
    return model


def score(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id``, ``expected_grade``, ``tail`` (probability of the highest grade), ``kept``.

    Null and empty texts have no words; they are scored by their shape alone.
    ``kept`` is ``tail >= model.cut``.  Other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                tails = model.tails(model.score(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= model.cut)], ["id", "expected_grade", "tail", "kept"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {df.schema[id_col].dataType.simpleString()}, expected_grade double, tail double, kept boolean")


def select(df: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose tail probability reaches the model's cut."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(model.tails(model.score(batch.column(text_col)))[:, -1] >= model.cut))

    return df.mapInArrow(tidy(run), df.schema)
