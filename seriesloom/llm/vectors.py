"""Embedding near-duplicates: a forest of random-projection trees with spill, exact check in leaves, union."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.simhash import forest
from seriesloom.llm.tables import components, saved

COSINE = 0.93
TREES = 4
#: Vectors of a leaf that the splits aim at, and vectors of one leaf that a single task compares.
LEAF = 1024
LARGE_LEAF = 4096
#: Bound of the sample that the splits are fitted on; every vector is put into the trees.
FIT_ROWS = 20_000
#: Half width of the overlap, in standard deviations of the projected distance of a pair at the threshold.
SPILL = 0.5
#: A split that leaves more than this part on one side is not made: a crowd within the overlap stays one leaf.
LARGEST_PART = 0.7
SEED = 11


class Tree:
    """Recursive random splits at the sample's median; points near a split go to both sides."""

    def __init__(self, sample: np.ndarray, leaf: float, spill: float, rng: np.random.Generator) -> None:
        self.directions: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # (direction, threshold, left, right), or (leaf number,)
        self.leaves = 0
        self.spill = spill
        self._grow(sample, leaf, rng)
        self.at = {node[0]: k for k, node in enumerate(self.nodes) if len(node) == 1}  # node of each leaf

    def _grow(self, x: np.ndarray, leaf: float, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(x) > leaf:
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            at = x @ direction
            middle = float(np.median(at))
            left, right = at <= middle + self.spill, at >= middle - self.spill
            if max(left.sum(), right.sum()) <= LARGEST_PART * len(x):
                self.directions.append(direction)
                k = len(self.directions) - 1
                self.nodes[me] = (k, middle, self._grow(x[left], leaf, rng), self._grow(x[right], leaf, rng))
                return me
        self.nodes[me] = (self.leaves,)
        self.leaves += 1
        return me

    def split(self, leaf: int, direction: np.ndarray, middle: float) -> None:
        """Split a leaf; its left part keeps the number, the right one takes the next."""
        if not self.directions or self.directions[-1] is not direction:
            self.directions.append(direction)
        me = self.at[leaf]
        left, right = len(self.nodes), len(self.nodes) + 1
        self.nodes += [(leaf,), (self.leaves,)]
        self.nodes[me] = (len(self.directions) - 1, middle, left, right)
        self.at[leaf], self.at[self.leaves] = left, right
        self.leaves += 1

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row of ``x`` falls into."""
        rows, found, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        while todo:
            k, at = todo.pop()
            node = self.nodes[k]
            if len(node) == 1:
                rows.append(at)
                found.append(np.full(len(at), node[0]))
                continue
            projected = x[at] @ self.directions[node[0]]
            todo.append((node[2], at[projected <= node[1] + self.spill]))
            todo.append((node[3], at[projected >= node[1] - self.spill]))
        return np.concatenate(rows), np.concatenate(found)


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as unit rows in double precision, padded with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    top = np.abs(out).max(axis=1, keepdims=True)  # against overflow and underflow of the squares
    out /= top
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit_forest(classes: DataFrame, width: int, total: int, cosine: float, trees: int, leaf: int) -> list[Tree]:
    """Trees over a sample of at most FIT_ROWS vectors, chosen by a hash of their number, and over all where that does not suffice."""
    sample = classes.select("vector", "node").orderBy(F.xxhash64("node"), "node").limit(FIT_ROWS).select("vector").toArrow()
    x = unit_rows(sample["vector"].combine_chunks(), width) if len(sample) else np.zeros((0, width))
    aim = leaf * len(x) / max(1, total)
    spill = SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(max(1, width))
    grown = [Tree(x, max(8.0, aim), spill, np.random.default_rng((SEED, t))) for t in range(trees)]
    return grown if aim >= 8 else deepened(classes, width, grown, leaf)


def deepened(classes: DataFrame, width: int, trees: list[Tree], leaf: int) -> list[Tree]:
    """``trees`` with leaves of more than 2 * ``leaf`` vectors of one label split further, at medians of all their members.

    The sample ends where a leaf has few of its vectors; from there on every level is one
    aggregation over all vectors in the leaves that are still too large, along one new random
    direction for each tree.  So leaves do not grow with the table.  A crowd that no direction
    parts stays a leaf and is compared in blocks.
    """
    rows = classes.select(F.xxhash64("label").alias("label"), "vector")
    closed: set[tuple[int, int]] = set()
    level = 0
    while True:
        level += 1

        def sizes(batches):
            for batch in batches:
                label, x = batch.column(0).to_numpy(), unit_rows(batch.column(1), width)
                for t, tree in enumerate(trees):
                    row, found = tree.leaves_of(x)
                    kinds, n = np.unique(np.stack([found, label[row]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t)), pa.array(kinds[0]), pa.array(kinds[1]), pa.array(n)], ["tree", "leaf", "label", "n"])

        counts = rows.mapInArrow(sizes, "tree long, leaf long, label long, n long").groupBy("tree", "leaf", "label").agg(F.sum("n").alias("n"))
        large = {(r.tree, r.leaf) for r in counts.where(F.col("n") > 2 * leaf).select("tree", "leaf").distinct().collect()} - closed
        if not large:
            return trees
        ways = [np.random.default_rng((SEED, t, level)).standard_normal(width) for t in range(len(trees))]
        ways = [w / np.linalg.norm(w) for w in ways]
        wanted = [np.array(sorted(f for k, f in large if k == t), np.int64) for t in range(len(trees))]

        def projected(batches):
            for batch in batches:
                x = unit_rows(batch.column(1), width)
                for t, tree in enumerate(trees):
                    row, found = tree.leaves_of(x)
                    own = np.isin(found, wanted[t])
                    place = (x @ ways[t])[row[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), t)), pa.array(found[own]), pa.array(place)], ["tree", "leaf", "p"])

        percent = F.percentile_approx("p", F.array(*[F.lit(k / 100) for k in range(101)]), 1000)
        for r in rows.mapInArrow(projected, "tree long, leaf long, p double").groupBy("tree", "leaf").agg(percent.alias("q")).orderBy("tree", "leaf").collect():
            q, spill = np.array(r.q), trees[r.tree].spill
            if max((q <= q[50] + spill).mean(), (q >= q[50] - spill).mean()) <= LARGEST_PART:
                trees[r.tree].split(r.leaf, ways[r.tree], float(q[50]))
            else:
                closed.add((r.tree, r.leaf))


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest leaf number that rows of ``a`` and ``b`` share; rows are ascending and padded with -1 and -2."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        shared = (a[:, k : k + 1] == b).any(axis=1)
        out = np.where(shared, np.minimum(out, a[:, k]), out)
    return out


def leaf_links(x: np.ndarray, n: np.ndarray, leaves: np.ndarray, leaf: int, block: np.ndarray, cosine: float):
    """Pairs of one leaf at ``cosine`` or more: links of each row that this leaf is the first to find, and all pairs as a forest.

    ``block`` is 0 for a whole leaf; for a pair of blocks it is 1 and 2, and only pairs across count.
    """
    counts, ends = np.zeros(len(x), np.int64), []
    for lo in range(0, len(x), 512):
        near = x[lo : lo + 512] @ x[lo:].T >= cosine
        i, j = np.nonzero(near)
        keep = (j > i) & ((block[i + lo] != block[j + lo]) | (block[i + lo] == 0))
        i, j = i[keep] + lo, j[keep] + lo
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            ends.append(forest(a, b))
            new = first_common(leaves[a], np.where(leaves[b] < 0, -2, leaves[b])) == leaf
            counts += np.bincount(a[new], n[b[new]], len(x)).astype(np.int64) + np.bincount(b[new], n[a[new]], len(x)).astype(np.int64)
    if not ends:
        return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return counts, *forest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))


def class_links(classes: DataFrame, width: int, trees: list[Tree], cosine: float, large: int) -> DataFrame:
    """(node long, links long, other long): number of linked vectors for a node, or a link of two nodes."""
    vector_type = classes.schema["vector"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            x = unit_rows(batch.column(3), width)
            rows, found, base = [], [], 0
            for tree in trees:
                r, leaf = tree.leaves_of(x)
                rows.append(r)
                found.append(leaf + base)
                base += tree.leaves
            rows, found = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))
            for lo in range(0, len(rows), 8192):
                at = pa.array(rows[lo : lo + 8192])
                columns = [batch.column(k).take(at) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 8192]), *columns, lists.take(at)], ["leaf", "label", "node", "n", "vector", "leaves"])

    def compare(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = held.select(["label", "leaf", "a", "b"])
            first, last = keys.slice(0, 1).to_pylist(), keys.slice(len(keys) - 1).to_pylist()
            if first != last:  # the last run may go on
                done = runs(held)
                yield from (links(held.slice(a, b - a)) for a, b in done[:-1])
                held = held.slice(done[-1][0]).combine_chunks()
        if held is not None and len(held):
            yield from (links(held.slice(a, b - a)) for a, b in runs(held))

    def runs(table):
        changed = np.zeros(len(table) - 1, bool)
        for name in ("label", "leaf", "a", "b"):
            values = table[name].combine_chunks()
            values = values.dictionary_encode().indices.to_numpy() if not pa.types.is_integer(values.type) else values.to_numpy(zero_copy_only=False)
            changed |= values[1:] != values[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(table)]
        return list(zip(edges[:-1], edges[1:], strict=True))

    def links(run):
        run = run.combine_chunks()
        node, n = run["node"].to_numpy(), run["n"].to_numpy()
        a, b = run["a"][0].as_py(), run["b"][0].as_py()
        block = np.zeros(len(node), np.int8) if a == b else np.where(run["block"].to_numpy() == a, 1, 2)
        lists = run["leaves"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        leaves = np.full((len(node), int(sizes.max())), -1)
        leaves[np.arange(leaves.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        counts, x, y = leaf_links(unit_rows(run["vector"].combine_chunks(), width), n, leaves, run["leaf"][0].as_py(), block, cosine)
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[some], node[x]])), pa.array(np.concatenate([counts[some], np.zeros(len(x), np.int64)])),
                pa.array(np.concatenate([np.zeros(len(some), np.int64), node[y]]), mask=np.arange(len(some) + len(x)) < len(some)),
            ],
            ["node", "links", "other"],
        )

    labels = classes.schema["label"].dataType.simpleString()
    rows = classes.select("label", "node", "n", "vector").mapInArrow(
        assign, f"leaf long, label {labels}, node long, n long, vector {vector_type}, leaves array<long>"
    )
    crowded = saved(rows.groupBy("label", "leaf").agg(F.ceil(F.count("*") / large).cast("int").alias("blocks")).where("blocks > 1"), "crowded")
    rows = rows.withColumns({"block": F.lit(0), "a": F.lit(0), "b": F.lit(0)})
    if crowded.head(1):
        every = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")),
        )
        cut = rows.drop("a", "b").join(crowded, ["label", "leaf"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        cut = cut.withColumn("pair", F.explode(every)).select(*[c for c in rows.columns if c not in ("a", "b")], "pair.a", "pair.b")
        rows = rows.join(crowded, ["label", "leaf"], "left_anti").select(*cut.columns).unionByName(cut)
    key = ["label", "leaf", "a", "b"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "node long, links long, other long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
    trees: int = TREES, leaf: int = LEAF, large: int = LARGE_LEAF,
) -> DataFrame:
    """(vec_id, n_links long, component_id, kept boolean) for every row: links between vectors of one label.

    Equal vectors of a label are one class that is compared once.  Each tree splits by random
    directions, points near a split fall into both sides, and each class is compared with the
    classes of its label in its leaves.  A pair that meets in several leaves is counted in the
    first of them only, so no list of pairs is ever written: leaves give sums and forests.
    Leaves with more than ``large`` members are compared in blocks, exactly.  Pairs found are
    exact (double precision); pairs at the threshold that meet in no leaf are missed, about one
    in a thousand (measured in the tests).

    Null label, and vectors that are null, empty, zero or hold null or non-finite components: no
    links, a component of their own.  Vectors of different lengths never link.  Null id: no
    links, component null, not kept.  Repeated ids: rows of their own that link like others.
    Empty table: no rows.  Other columns are not read.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False)))
    # two hashes of different seeds stand for the vector; its length parts vectors of different lengths
    rows = rows.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(1), "vector", "label"), "width": F.size("vector")})
    grouped = rows.where("valid").groupBy("label", "width", "k1", "k2").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("low_id"), F.first("vector").alias("vector")
    )
    grouped = grouped.withColumn("label", F.struct("label", "width")).withColumn("node", F.monotonically_increasing_id())
    classes = saved(grouped.withColumn("label", F.to_json("label")), "vector-classes")
    total, width = classes.agg(F.count("*"), F.max("width")).first()
    found = saved(class_links(classes, width or 1, fit_forest(classes, width or 1, total, cosine, trees, leaf), cosine, large), "vector-links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("k1", "k2", "n", "low_id", "node").join(linked, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("component", "node"))
    low = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = named.join(low, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    good = rows.where("valid").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
