"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, components.

1. Equal vectors collapse to the smallest id (a partial aggregate), with their
   number; a vector that is null, zero or holds a null or non-finite number
   takes no part.
2. Spherical k-means on a bounded sample (the smallest hashes of the ids, 16 rows
   a cell and ``LEAST_SAMPLE`` at least) gives the cells, which grow in number
   with the table up to ``MOST_CELLS``; many cells are fitted in two levels.
3. Every vector has a home cell and visits others.  For a partner b of a at the
   threshold, |a - b| is at most r = sqrt(2 - 2 threshold).  If a is at home with
   centroid c and b with d, then a prefers c, b prefers d, and the two margins
   add up to t = (a - b)(c - d); so one of them is at most t / 2, and t is at
   most r |c - d|.  A vector visits each cell that it prefers its own to by no
   more than a window, and a pair is found if either visits the other's home.
   With the window r |c - d| / 2 no link can be missed, but in many dimensions t
   is far smaller.  So the window is fitted to the data: its width per pair of
   cells is a number of standard deviations of t, by the covariance of the
   sample, of its rows about their centroids, and of the differences of nearest
   rows (whichever is largest along c - d); and this number is raised until at
   least ``target`` of partners are found that are planted at the threshold, in
   directions that occur in the sample.  ``target=1`` takes the exact bound.
4. Home rows meet all rows of the cell in blocks of bounded size, by matrix
   products in double precision.  Links are counted per vector and turned into
   a spanning forest per block; pairs are never written out.
5. Components join the forests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._store import discard, settle
from gaugeworks.llm._words import tidy
from gaugeworks.llm.components import components

THRESHOLD, TARGET, CELL_ROWS, MOST_CELLS, BLOCK = 0.9, 0.999, 256, 16_384, 2048
LEAST_SAMPLE, SAMPLE_A_CELL = 20_480, 16
#: Up to so many cells are fitted at once.
FLAT_CELLS = 512
PLANTED, DRAWN = 4096, 4096


def _kmeans(unit: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``k`` unit centroids of unit rows and each row's own; an empty cell takes a row that fits its own worst."""
    centres = unit[draw.choice(len(unit), k, replace=False)].copy()
    best, near = np.empty(len(unit), np.int64), np.empty(len(unit))
    for step in range(rounds + 1):
        for i in range(0, len(unit), 4096):
            score = unit[i : i + 4096] @ centres.T
            best[i : i + 4096], near[i : i + 4096] = score.argmax(axis=1), score.max(axis=1)
        if step == rounds:
            break
        sums = np.zeros_like(centres)
        np.add.at(sums, best, unit)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        sums[empty] = unit[np.argsort(near)[: len(empty)]]
        centres = sums / np.linalg.norm(sums, axis=1)[:, None]
    return centres, best


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """``k`` unit centroids of unit rows; more than ``FLAT_CELLS`` are fitted inside coarse cells, as many in each as its rows ask for."""
    draw = np.random.default_rng(seed)
    if k <= FLAT_CELLS:
        return _kmeans(unit, k, rounds, draw)[0]
    coarse = _kmeans(unit, math.isqrt(k), rounds, draw)[1]
    out = []
    for c in np.unique(coarse):
        rows = unit[coarse == c]
        out.append(_kmeans(rows, max(1, min(len(rows), round(k * len(rows) / len(unit)))), rounds, draw)[0])
    return np.concatenate(out)


class Window:
    """Which cells a vector visits: those that it prefers its own to by no more than a margin.

    ``deviations`` of None is the exact bound.
    """

    def __init__(self, centres: np.ndarray, radius: float, shapes: list[np.ndarray], deviations: float | None):
        self.centres, self.radius, self.deviations = centres, radius, deviations
        self.shapes = [] if deviations is None else [(centres @ s, np.einsum("ij,ij->i", centres @ s, centres)) for s in shapes]

    def margin(self, cells: np.ndarray) -> np.ndarray:
        """``cells`` x all cells."""
        apart = np.sqrt(np.maximum(2 - 2 * self.centres[cells] @ self.centres.T, 0))
        out = apart / 2
        if self.deviations is not None:
            spread = np.zeros_like(out)
            for turned, own in self.shapes:
                np.maximum(spread, own[cells][:, None] + own[None, :] - 2 * turned[cells] @ self.centres.T, out=spread)
            out = np.minimum(out, self.deviations / 2 * np.sqrt(spread))
        return out * self.radius + 1e-9  # for rounding

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each row, and whether it visits each cell (rows x cells)."""
        score = unit @ self.centres.T
        home = score.argmax(axis=1)
        cells, which = np.unique(home, return_inverse=True)
        rows = np.arange(len(unit))
        seen = score[rows, home][:, None] - score <= self.margin(cells)[which]
        seen[rows, home] = True
        return home, seen


def fit_window(unit: np.ndarray, centres: np.ndarray, threshold: float = THRESHOLD, target: float = TARGET, seed: int = 0) -> Window:
    """The narrowest window, from three standard deviations up, that finds ``target`` of planted partners; the exact bound if none does."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    if target >= 1 or len(centres) < 2 or len(unit) < 3:
        return Window(centres, radius, [], None)
    draw = np.random.default_rng(seed)
    rows = unit[draw.choice(len(unit), min(len(unit), DRAWN), replace=False)]
    apart = rows[draw.permutation(len(rows))] - rows  # between any two
    home = (rows @ centres.T).argmax(axis=1)
    nearest = []
    for i in range(0, len(rows), 512):
        score = rows[i : i + 512] @ rows.T
        score[np.arange(len(score)), np.arange(i, i + len(score))] = -2
        nearest.append(rows[score.argmax(axis=1)] - rows[i : i + 512])
    steps = [apart, rows - centres[home], np.concatenate(nearest)]
    steps = [x[np.linalg.norm(x, axis=1) > 1e-9] for x in steps]
    steps = [x / np.linalg.norm(x, axis=1)[:, None] for x in steps if len(x)]
    shapes = [x.T @ x / len(x) for x in steps]
    # partners at the threshold exactly: the hardest to find
    a, b = [], []
    for x in steps:
        base, way = rows[draw.integers(0, len(rows), PLANTED)], x[draw.integers(0, len(x), PLANTED)]
        way = way - np.einsum("ij,ij->i", way, base)[:, None] * base
        size = np.linalg.norm(way, axis=1)
        held = size > 1e-6
        a.append(base[held])
        b.append(threshold * base[held] + math.sqrt(1 - threshold**2) * way[held] / size[held][:, None])
    a, b = np.concatenate(a), np.concatenate(b)
    for deviations in (3.0, 3.5, 4.0, 5.0, 6.0, 8.0):
        window = Window(centres, radius, shapes, deviations)
        hits = 0
        for i in range(0, len(a), 512):
            (one, sees), (two, seen) = window.visits(a[i : i + 512]), window.visits(b[i : i + 512])
            rows_ = np.arange(len(one))
            hits += int((sees[rows_, two] | seen[rows_, one]).sum())
        if hits >= target * len(a):
            return window
    return Window(centres, radius, [], None)


def _unit(packed: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _usual(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of the packed vectors that have the most frequent length (of several, the least)."""
    packed = column.combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    size = np.diff(ends)
    kinds, times = np.unique(size, return_counts=True)
    usual = int(kinds[times.argmax()])
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    rows = np.concatenate([data[i : i + usual] for i in ends[:-1][size == usual].tolist()]) if len(kinds) > 1 else data[ends[0] : ends[-1]]
    rows = np.frombuffer(rows.tobytes(), np.float64).reshape(-1, usual // 8)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _pack(batches):
    for batch in batches:
        column = batch.column("v")
        offsets, values = column.offsets.to_numpy(), column.values
        numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        packed = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            row = numbers[a:b]
            good = column[i].is_valid and b > a and np.isfinite(row).all() and row.any()
            if good:
                row = row / np.abs(row).max() + 0.0  # neither overflow nor underflow in the norm, no minus zero
            packed.append(row.astype(np.float64).tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])


def _placer(window: Window):
    width, step = window.centres.shape[1] * 8, max(64, min(2048, (4 << 20) // len(window.centres)))

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                packed = batch.column("packed").to_pylist()
                home, cells = np.empty(len(packed), np.int32), [None] * len(packed)
                fits = np.flatnonzero([len(x) == width for x in packed])
                if len(fits):
                    own, seen = window.visits(_unit([packed[i] for i in fits]))
                    home[fits] = own
                    for i, v in zip(fits.tolist(), seen, strict=True):
                        cells[i] = np.flatnonzero(v).astype(np.int32)
                for i, x in enumerate(packed):
                    if cells[i] is None:  # another dimension: one cell of its own
                        home[i] = -len(x)
                        cells[i] = np.array([-len(x)], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("packed"), batch.column("n"), pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["id", "packed", "n", "home", "cells"])

    return run


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        first = np.array(table.column("first").to_pylist(), bool)
        if not first.any() or first.all():
            return _LINKS.empty_table()
        ids, home, n = (table.column(c).to_numpy() for c in ("id", "home", "n"))
        unit, cells = _unit(table.column("packed").to_pylist()), table.column("cells").combine_chunks()
        starts, visited = cells.offsets.to_numpy(), cells.values.to_numpy()
        own, other = np.flatnonzero(first), np.flatnonzero(~first)
        homes, which = np.unique(home[other], return_inverse=True)
        links = np.zeros(len(ids), np.int64)
        parent = list(range(len(ids)))
        row_of: dict[int, int] = {}
        for i in own.tolist():
            row_of.setdefault(int(ids[i]), i)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def join(i: int, j: int) -> None:
            i, j = root(i), root(j)
            if i != j:
                low, high = (i, j) if ids[i] <= ids[j] else (j, i)
                parent[high] = low

        for k in range(0, len(own), 512):
            block = own[k : k + 512]
            near = unit[block] @ unit[other].T >= threshold
            near &= ids[block][:, None] != ids[other][None, :]
            links[block] += near @ n[other]
            seen = np.zeros((len(block), len(homes)), bool)  # does the home row visit that home? then the other row counts there
            for r, i in enumerate(block.tolist()):
                seen[r] = np.isin(homes, visited[starts[i] : starts[i + 1]])
            alone = near & ~seen[:, which] & (home[other] != cell)[None, :]
            links[other] += n[block] @ alone
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                i = int(block[r])
                for j in other[near[r]].tolist():
                    join(i, row_of.get(int(ids[j]), j))
        touched = np.flatnonzero((links > 0) | (np.array([root(i) for i in range(len(ids))]) != np.arange(len(ids))))
        return pa.table({"id": ids[touched], "links": links[touched], "root": ids[[root(i) for i in touched.tolist()]] if len(touched) else np.empty(0, np.int64)}, schema=_LINKS)

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``id, n_links, component_id, kept``.

    Links found have a cosine of ``threshold`` at least; of partners at the
    threshold a share of about ``target`` is found, nearer ones more surely, and
    all with ``target=1``.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id that links reach, ``kept`` holds where it is the own id.  A
    vector that takes no part has no links and is kept; so is a row with a null
    id, whose component is null.  Vectors of different lengths are not
    compared.  Rows of one id with different vectors are one node.  Other
    columns are not read.
    """
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("v"))
    packed = settle(own.mapInArrow(tidy(_pack), "id long, packed binary").withColumn("digest", F.sha2("packed", 256)), "vectors")
    full = packed.where("packed is not null and id is not null")
    reps = settle(full.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("packed").alias("packed")), "reps")
    total = reps.count()
    k = max(1, min(MOST_CELLS, total // cell_rows))
    sample = reps.select("packed").orderBy(F.xxhash64("id"), "id").limit(max(LEAST_SAMPLE, SAMPLE_A_CELL * k)).toArrow().column("packed")
    unit = _usual(sample) if total else np.ones((1, 1))
    del sample
    centres = spherical_kmeans(unit, max(1, min(k, len(unit) // 4)))
    window = fit_window(unit, centres, threshold, target)
    placed = settle(reps.select("id", "packed", "n").mapInArrow(tidy(_placer(window)), "id long, packed binary, n long, home int, cells array<int>"), "placed")
    spread = placed.select("id", "home", F.explode("cells").alias("cell"))
    load = spread.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("home") == F.col("cell"), 1).otherwise(0)).alias("homes"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(float(block))).cast("int")
    load = load.where("homes > 0 and rows > 1").select("cell", blocks("homes").alias("n_own"), blocks("rows").alias("n_other"))
    every = placed.withColumn("cell", F.explode("cells")).join(load, "cell")
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "i", "j", "first", "id", "packed", "n", "home", "cells"]
    left = every.where("home = cell").withColumn("i", spot("n_own")).withColumn("j", upto("n_other")).withColumn("first", F.lit(True)).select(columns)
    right = every.withColumn("j", spot("n_other")).withColumn("i", upto("n_own")).withColumns({"first": F.lit(False), "cells": F.lit(None).cast("array<int>")}).select(columns)
    found = settle(left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = reps.select("digest", F.col("id").alias("rep"), "n").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = settle(known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "known")
    discard(reps, placed, found, roots)
    linked = full.select("id", "digest").join(known, "digest").select("id", "n_links", "component_id")
    alone = packed.where("packed is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
