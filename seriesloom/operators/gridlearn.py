"""Learners fitted for every cell of a grid together: each step of all fits is one pass over the training rows.

A training row stands once in its table, with the numbers of the cells it belongs to.  Tasks add up, for every
cell, what a step needs (gradient and curvature, or counts by node, feature and bin); the sums meet by cell, where
the step is solved.  Only coefficients or split tables, whose size the design bounds, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import fresh_path

BINS = 32
#: Memberships (row and cell) that make a task of their own worth its sums.
TASK_ROWS = 2000
#: Trees whose counts meet in one row, and counts that a task holds at a time.
CHUNK, DENSE = 25, 1 << 23


def training_rows(windows: DataFrame, features: Sequence[str], sets: DataFrame, cell: Column) -> DataFrame:
    """(key long, cls int, x array<double>, cells array<int>), written once: windows of the training series with their cells.

    ``windows`` has (series_id, w, cls) and the features, NULL ones count as 0; ``sets`` has one row per training
    series and cell, and ``cell`` numbers the cell.
    """
    own = sets.select("series_id", cell.cast("int").alias("_c")).groupBy("series_id").agg(F.collect_set("_c").alias("cells"))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x")
    rows = windows.join(own, "series_id").select(F.xxhash64("series_id", "w").alias("key"), F.col("cls").cast("int").alias("cls"), x, "cells")
    path = fresh_path(windows.sparkSession, "training-rows")
    rows.repartition(windows.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return windows.sparkSession.read.parquet(path)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, features, row and cell of each membership)."""
    x, cells = batch.column("x"), batch.column("cells")
    size = np.diff(cells.offsets.to_numpy())
    members = np.repeat(np.arange(batch.num_rows), size), cells.flatten().to_numpy()
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column("key").to_numpy(), batch.column("cls").to_numpy(zero_copy_only=False), values, *members


def class_counts(rows: DataFrame, n_cells: int, n_classes: int) -> np.ndarray:
    """Training rows by cell and class."""
    out = np.zeros((n_cells, n_classes), np.int64)
    for r in rows.select("cls", F.explode("cells").alias("c")).groupBy("c", "cls").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.c, r.cls] = r.n
    return out


def balanced(counts: np.ndarray) -> np.ndarray:
    """Weights n / (K * n_c) by cell and class, K the classes that occur; 0 for the others."""
    k = np.maximum(1, (counts > 0).sum(axis=1, keepdims=True))
    return np.where(counts > 0, counts.sum(axis=1, keepdims=True) / (k * np.maximum(counts, 1)), 0.0)


@dataclass
class Logistic:
    """Fitted cells: coefficients (cell, feature + intercept, class) of the scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    gradient: np.ndarray  # largest component of each cell's gradient, over its rows
    steps: int

    def proba(self, cell: int, x: np.ndarray) -> np.ndarray:
        return softmax(self.scaled(cell, x) @ self.coef[cell])

    def scaled(self, cell: int, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.mean[cell], self.scale[cell])


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and a column of ones; a constant feature is 0."""
    z = np.where(scale > 0, (x - mean) / np.where(scale > 0, scale, 1.0), 0.0)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_logistic(rows: DataFrame, n_cells: int, n_classes: int, tolerance: float = 1e-8, max_steps: int = 50) -> Logistic:
    """Multinomial logistic regression of every cell by Newton steps, a job for each step of all cells.

    The loss is the sum of balanced log losses plus half the squares of the coefficients, intercepts excepted, of
    features standardised over the cell's rows.  A step that raises a cell's loss is halved.  Ends where every cell's
    gradient, over its rows, is at most ``tolerance``.
    """
    counts = class_counts(rows, n_cells, n_classes)
    weight, total = balanced(counts), np.maximum(1, counts.sum(axis=1))
    mean, sd = _moments(rows, n_cells)
    d = mean.shape[1] + 1
    penalty = np.append(np.ones(d - 1), 0.0)
    pairs = [(a, b) for a in range(n_classes) for b in range(a, n_classes)]  # blocks of the symmetric curvature
    # as many tasks as have some rows each: every task sends its sums of all cells
    rows = rows.coalesce(max(1, int(counts.sum()) // TASK_ROWS))

    def step(coef: np.ndarray, todo: list[int]) -> dict[int, tuple[float, float, np.ndarray]]:
        """Loss, largest gradient component and Newton step of the cells ``todo`` at ``coef``."""
        wanted = np.zeros(n_cells, bool)
        wanted[todo] = True

        def partial(batches):
            loss, grad, curve = {}, {}, {}
            for batch in batches:
                _, cls, x, row, cell = _rows(batch)
                for c in np.unique(cell[wanted[cell]]).tolist():
                    own = row[cell == c]
                    z, y = scaled(x[own], mean[c], sd[c]), cls[own]
                    p, w = softmax(z @ coef[c]), weight[c][y]
                    off = p.copy()
                    off[np.arange(len(y)), y] -= 1
                    loss[c] = loss.get(c, 0.0) - float(w @ np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))
                    grad[c] = grad.get(c, 0.0) + z.T @ (off * w[:, None])
                    curve[c] = curve.get(c, 0.0) + np.stack([z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]) for a, b in pairs])
            for c in loss:
                values = np.concatenate([[loss[c]], grad[c].T.ravel(), curve[c].ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["cell", "sums"])

        def solved(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[c] = sums.get(c, 0.0) + np.frombuffer(raw)
            n = n_classes * d
            for c, s in sums.items():
                beta, ridge = coef[c].T.ravel(), np.tile(penalty, n_classes)
                whole = np.empty((n_classes, d, n_classes, d))
                for (a, b), block in zip(pairs, s[n + 1 :].reshape(-1, d, d), strict=True):
                    whole[a, :, b, :], whole[b, :, a, :] = block, block.T
                grad, curve = s[1 : n + 1] + ridge * beta, whole.reshape(n, n) + np.diag(ridge)
                shift = 1 - ridge  # equal intercepts change nothing: that direction stays at 0
                move = -np.linalg.solve(curve + np.outer(shift, shift), grad)
                out = np.concatenate([[s[0] + 0.5 * float(ridge @ beta**2), np.abs(grad).max() / total[c], float(grad @ move)], move])
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["cell", "step"])

        sums = rows.mapInArrow(partial, "cell int, sums binary").repartition(max(1, min(len(todo), 200)), "cell")
        found = sums.mapInArrow(solved, "cell int, step binary").collect()  # a row per cell
        return {r.cell: (v[0], v[1], v[2], v[3:].reshape(n_classes, d).T) for r in found for v in [np.frombuffer(r.step)]}

    coef, gradient = np.zeros((n_cells, d, n_classes)), np.zeros(n_cells)
    loss, slope, move, size = np.full(n_cells, np.inf), np.zeros(n_cells), np.zeros_like(coef), np.ones(n_cells)
    todo, steps = np.flatnonzero(counts.sum(axis=1)).tolist(), 0
    trial = coef.copy()
    while todo and steps < max_steps:
        steps += 1
        for c, (value, grad, down, ahead) in step(trial, todo).items():
            if value <= loss[c] + 1e-4 * size[c] * slope[c] + 1e-12 * abs(value):
                coef[c], loss[c], gradient[c], slope[c], move[c], size[c] = trial[c], value, grad, down, ahead, 1.0
            else:
                size[c] /= 2
        todo = [c for c in todo if gradient[c] > tolerance or not np.isfinite(loss[c])]
        for c in todo:
            trial[c] = coef[c] + size[c] * move[c]
    return Logistic(mean, sd, coef, gradient, steps)


def _moments(rows: DataFrame, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample SD of every feature by cell."""
    first = rows.select("x").first()
    width = len(first.x) if first else 0
    at = [F.get("x", F.lit(i)) for i in range(width)]
    found = rows.select(F.explode("cells").alias("c"), "x").groupBy("c").agg(F.array(*[F.avg(a) for a in at]).alias("m"), F.array(*[F.stddev_samp(a) for a in at]).alias("s"))
    mean, sd = np.zeros((n_cells, width)), np.zeros((n_cells, width))
    for r in found.collect():
        mean[r.c] = r.m
        sd[r.c] = [s or 0.0 for s in r.s]
    return mean, np.where(np.isfinite(sd), sd, 0.0)


@dataclass
class Forest:
    """Grown forests: split tables by cell, and class shares of the nodes.

    ``feature`` (cell: tree, node) is -1 in a leaf; rows whose bin is at most ``bin`` go to ``left``, the others to
    the node after it.
    """

    edges: np.ndarray  # feature, upper edges of its bins
    feature: list[np.ndarray]
    bin: list[np.ndarray]
    left: list[np.ndarray]
    share: list[np.ndarray]
    jobs: int

    def proba(self, cell: int, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the class shares of the leaf; a part of the rows at a time."""
        trees, nodes = self.feature[cell].shape
        out = np.empty((len(x), self.share[cell].shape[2]))
        for lo in range(0, len(x), 256):
            b = binned(x[lo : lo + 256], self.edges)
            at = descended(b, self.feature[cell], self.bin[cell], self.left[cell])
            out[lo : lo + 256] = self.share[cell][np.arange(trees)[None, :], at].mean(axis=1)
        return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def descended(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Node of each row in each tree (row, tree)."""
    tree, row = np.arange(feature.shape[0])[None, :], np.arange(len(bins))[:, None]
    at = np.zeros((len(bins), feature.shape[0]), np.int64)
    while True:
        f = feature[tree, at]
        inner = f >= 0
        if not inner.any():
            return at
        beyond = bins[row, np.maximum(f, 0)] > cut[tree, at]
        at = np.where(inner, left[tree, at] + beyond, at)


def drawn(key: np.ndarray, seed: int, cell: int, trees: np.ndarray) -> np.ndarray:
    """Poisson(1) weights (row, tree) from a hash of the row's key, the cell and the tree: the same wherever the row is."""
    base = np.uint64((seed * 0x9E3779B97F4A7C15 + cell * 0xC2B2AE3D27D4EB4F + 1) & (2**64 - 1))
    h = key.view(np.uint64)[:, None] ^ (base + trees.astype(np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, u, side="right")


POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(1, np.arange(19))))


def fit_forest(rows: DataFrame, n_cells: int, n_classes: int, trees: int = 300, depth: int = 8, bins: int = BINS, tried: int | None = None, seed: int = 1) -> Forest:
    """Random forests of every cell, all grown a level at a time: a job counts every open node of every tree of every cell.

    Rows weigh Poisson(1) in each tree; a node tries ``tried`` features (the root of their number) at the edges of
    ``bins`` quantile bins, and splits where balanced Gini impurity falls most.  Counts are whole numbers, so the
    result does not depend on how rows are dealt out.
    """
    first = rows.select("x").first()
    width = len(first.x) if first else 1
    tried = tried or max(1, round(width**0.5))
    probs = [k / bins for k in range(1, bins)]
    edges = np.full((width, bins - 1), np.inf)
    if first:
        found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), F.array(*map(F.lit, probs)), 10_000).alias(f"q{i}") for i in range(width)]).first()
        edges = np.array([found[f"q{i}"] for i in range(width)], float)
    weight = balanced(class_counts(rows, n_cells, n_classes))
    room = [1] * n_cells
    feature = [np.full((trees, 1), -1, np.int16) for _ in range(n_cells)]
    cut = [np.zeros((trees, 1), np.uint8) for _ in range(n_cells)]
    left = [np.zeros((trees, 1), np.int32) for _ in range(n_cells)]
    share = [np.full((trees, 1, n_classes), 1 / n_classes) for _ in range(n_cells)]
    # the open nodes of a cell: tree and node of each, sorted by tree
    open_nodes = [(np.arange(trees), np.zeros(trees, np.int64)) if weight[c].any() else (np.zeros(0, np.int64),) * 2 for c in range(n_cells)]
    jobs = 0
    for level in range(depth):
        subsets = [np.argsort(np.random.default_rng([seed, c, level]).random((len(t), width)), axis=1)[:, :tried].astype(np.uint8) for c, (t, _) in enumerate(open_nodes)]
        if not any(len(t) for t, _ in open_nodes):
            break
        jobs += 1
        now = (feature, cut, left)
        for c, chunk, out in _level(rows, now, open_nodes, subsets, edges, weight, trees, bins, n_classes, seed, level):
            tree, node = (x[chunk] for x in open_nodes[c])
            _grow(c, tree, node, subsets[c][chunk], out, feature, cut, left, share, room, weight[c])
        # children that are not pure go on
        for c in range(n_cells):
            tree, node = open_nodes[c]
            split = feature[c][tree, node] >= 0
            t, n = np.repeat(tree[split], 2), (left[c][tree[split], node[split]][:, None] + np.arange(2)).ravel()
            mixed = share[c][t, n].max(axis=1) < 1 - 1e-12 if len(t) else np.zeros(0, bool)
            open_nodes[c] = t[mixed], n[mixed]
    return Forest(edges, feature, cut, left, share, jobs)


def _level(rows, now, open_nodes, subsets, edges, weight, trees, bins, n_classes, seed, level) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, open nodes, best splits of these) from one job."""
    feature, cut, left = now
    tried = next(s.shape[1] for s in subsets if len(s))
    block = tried * bins * n_classes
    # open nodes of a cell in runs of whole trees, as many as CHUNK trees or DENSE counts allow
    chunks: list[list[np.ndarray]] = []
    for tree, _ in open_nodes:
        own, lo = [], 0
        while lo < len(tree):
            hi = int(np.searchsorted(tree, tree[lo] + CHUNK))
            while hi - lo > max(1, DENSE // block) and tree[hi - 1] > tree[lo]:
                hi = int(np.searchsorted(tree, tree[hi - 1]))
            own.append(np.arange(lo, hi))
            lo = hi
        chunks.append(own)

    def counted(batches):
        for batch in batches:
            key, cls, x, row, cell = _rows(batch)
            b = binned(x, edges)
            for c in np.unique(cell).tolist():
                own = row[cell == c]
                for k, chunk in enumerate(chunks[c]):
                    tree, node = (a[chunk] for a in open_nodes[c])
                    kinds = np.unique(tree)
                    at = descended(b[own], feature[c][kinds], cut[c][kinds], left[c][kinds])
                    slots = np.full((len(kinds), feature[c].shape[1]), -1)
                    slots[np.searchsorted(kinds, tree), node] = np.arange(len(chunk))
                    slot, times = slots[np.arange(len(kinds))[None, :], at], drawn(key[own], seed, c, kinds)
                    who, which = np.nonzero((slot >= 0) & (times > 0))
                    s, n = slot[who, which], times[who, which]
                    tried_bins = b[own[who][:, None], subsets[c][chunk][s]].astype(np.int64)
                    spot = ((s[:, None] * tried + np.arange(tried)) * bins + tried_bins) * n_classes + cls[own[who]][:, None]
                    sums = np.bincount(spot.ravel(), np.repeat(n, tried), len(chunk) * block)
                    spots = np.flatnonzero(sums)
                    raw = np.stack([spots, sums[spots].astype(np.int64)]).astype(np.int32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["cell", "chunk", "counts"])

    def chosen(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        last = None
        for batch in batches:
            for c, k, raw in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if last is not None and (c, k) != last:
                    yield best(last, sums.pop(last))
                last = (c, k)
                if last not in sums:
                    sums[last] = np.zeros(len(chunks[c][k]) * block)
                both = np.frombuffer(raw, np.int32).reshape(2, -1)
                sums[last][both[0]] += both[1]
        if last is not None:
            yield best(last, sums.pop(last))

    def best(at, counts):
        c, k = at
        h = counts.reshape(-1, tried, bins, n_classes)
        whole = h[:, 0].sum(axis=1)
        low = np.cumsum(h[:, :, :-1], axis=2)
        weighted, all_weighted = low * weight[c], whole * weight[c]
        n_low, n_all = weighted.sum(axis=3), all_weighted.sum(axis=1)
        n_rest = n_all[:, None, None] - n_low
        # the purer the sides, the larger the sum of squares over their sizes; of the other side by expanding its square
        squares, whole_squares = np.einsum("ajbk,ajbk->ajb", weighted, weighted), (all_weighted**2).sum(axis=1)
        rest = whole_squares[:, None, None] - 2 * np.einsum("ak,ajbk->ajb", all_weighted, weighted) + squares
        pure = squares / np.maximum(n_low, 1e-300) + rest / np.maximum(n_rest, 1e-300)
        before = whole_squares / np.maximum(n_all, 1e-300)
        gain = np.where((n_low > 0) & (n_rest > 1e-9), pure, -1.0).reshape(len(h), -1)
        pick = gain.argmax(axis=1)
        good = gain[np.arange(len(h)), pick] > before * (1 + 1e-9)
        j, b = np.divmod(pick, bins - 1)
        sides = low[np.arange(len(h)), j, b]
        out = np.concatenate([np.stack([np.where(good, j, -1), b], axis=1), whole, sides], axis=1)
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([k], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["cell", "chunk", "splits"])

    parts = max(1, min(sum(map(len, chunks)), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    met = rows.mapInArrow(counted, "cell int, chunk int, counts binary").repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk")
    for r in met.mapInArrow(chosen, "cell int, chunk int, splits binary").toLocalIterator():
        yield r.cell, chunks[r.cell][r.chunk], np.frombuffer(r.splits).reshape(len(chunks[r.cell][r.chunk]), -1)


def _grow(c, tree, node, subset, out, feature, cut, left, share, room, weight) -> None:
    """Enter the splits of some open nodes of a cell into its tables."""
    k = (out.shape[1] - 2) // 2
    whole, low = out[:, 2 : 2 + k] * weight, out[:, 2 + k :] * weight
    parts = lambda v: v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
    share[c][tree, node] = np.where(whole.sum(axis=1, keepdims=True) > 0, parts(whole), 1 / k)
    good = out[:, 0] >= 0
    t, n = tree[good], node[good]
    # children take the next two places of their tree
    order = np.arange(len(t)) - np.searchsorted(t, t)
    used = used_nodes(left[c])[t] + 2 * order
    need = int(used.max()) + 2 if len(t) else 0
    if need > feature[c].shape[1]:
        more = max(need, 2 * feature[c].shape[1]) - feature[c].shape[1]
        trees = feature[c].shape[0]
        feature[c] = np.concatenate([feature[c], np.full((trees, more), -1, np.int16)], axis=1)
        cut[c] = np.concatenate([cut[c], np.zeros((trees, more), np.uint8)], axis=1)
        left[c] = np.concatenate([left[c], np.zeros((trees, more), np.int32)], axis=1)
        share[c] = np.concatenate([share[c], np.zeros((trees, more, k))], axis=1)
    feature[c][t, n] = subset[good][np.arange(len(t)), out[good, 0].astype(int)]
    cut[c][t, n] = out[good, 1]
    left[c][t, n] = used
    share[c][t, used] = parts(low[good])
    share[c][t, used + 1] = parts(whole[good] - low[good])


def used_nodes(left: np.ndarray) -> np.ndarray:
    """Nodes of each tree so far: the last pair of children ends them."""
    return np.where(left.max(axis=1) > 0, left.max(axis=1) + 2, 1)


def grid_proba(windows: DataFrame, features: Sequence[str], cells: str, model: Logistic | Forest, n_classes: int) -> DataFrame:
    """``windows`` without features, a row for each of the numbers in the array column ``cells``, with cell int and proba array<double>."""
    kept = [c for c in windows.columns if c not in (*features, cells)]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("_x")
    types = {f.name: f.dataType for f in windows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in kept) + ", cell int, proba array<double>"

    def task(batches):
        for batch in batches:
            wide = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            size = np.diff(batch.column(cells).offsets.to_numpy())
            row, cell = np.repeat(np.arange(batch.num_rows), size), batch.column(cells).flatten().to_numpy()
            for c in np.unique(cell).tolist():
                own = row[cell == c]
                p = model.proba(c, wide[own])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * n_classes), pa.array(p.ravel()))
                same = batch.select(kept).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(np.full(len(own), c, np.int32)), lists], [*kept, "cell", "proba"])

    return windows.select(*kept, F.col(cells), x).mapInArrow(task, schema)
