"""Most similar vectors for every vector: a hierarchical k-means tree, searched best bin first through a priority queue."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import unpack


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a few rounds of Lloyd's algorithm from spread-out starts; fewer than ``k`` if rows coincide."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        home = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        counts = np.bincount(home, minlength=len(centres))
        sums = (home == np.arange(len(centres))[:, None]).astype(np.float32) @ x
        centres = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0).astype(np.float32)


@dataclass
class Tree:
    """Nodes by number: the centres of a node's children, and the children (negative: leaf ``-1 - n``)."""

    centres: list[np.ndarray]
    children: list[np.ndarray]
    leaf_share: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, leaves: int, branching: int = 16) -> "Tree":
        """A tree of about ``leaves`` leaves over a sample; nodes with more of the sample are split first."""
        tree = Tree([], [], np.zeros(0))
        shares: list[float] = []
        size = max(1.0, len(x) / max(1, leaves))

        def build(rows: np.ndarray) -> int:
            want = int(min(branching, np.ceil(len(rows) / size)))
            centres = k_means(x[rows], want) if want > 1 else np.zeros((0, x.shape[1]), np.float32)
            if len(centres) < 2:
                shares.append(len(rows) / max(1, len(x)))
                return -len(shares)
            node = len(tree.centres)
            tree.centres.append(centres)
            tree.children.append(np.zeros(len(centres), np.int64))
            home = np.argmax(x[rows] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for i in range(len(centres)):
                tree.children[node][i] = build(rows[home == i])
            return node

        build(np.arange(len(x)))
        tree.leaf_share = np.array(shares)
        return tree

    def visit(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves of ``search``."""
        return self.search(x, margin)[:2]

    def search(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, leaves and their bounds, best bin first: each row's own leaf, then the next nearest, as far as ``margin``.

        The queue holds entries (row, node, bound): how far the row is at least from the planes that part it
        from the node's cell. A node gives way to its children, whose bounds grow by the distance to the plane
        between them and the nearest child; a leaf is visited. Entries beyond ``margin`` are not put into the
        queue. As all others are taken in the end and no child has a lower bound than its node, a node is
        opened for all its rows at once, and leaves are put in the order of their bounds afterwards: the
        order in which a queue of each row would give them.
        """
        if not self.centres:
            return np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        queue = [(0, np.arange(len(x)), np.zeros(len(x), np.float32))]
        while queue:
            node, row, bound = queue.pop()
            if node < 0:
                out.append((row, -1 - node, bound))
                continue
            centres, children = self.centres[node], self.children[node]
            norms = (centres**2).sum(1)
            squared = norms - 2 * (x[row] @ centres.T)
            best = np.argmin(squared, axis=1)
            between = np.sqrt(np.maximum(norms[:, None] + norms - 2 * (centres @ centres.T), 0))
            apart = (squared - squared[np.arange(len(row)), best][:, None]) / np.maximum(2 * between[best], 1e-12)
            apart[np.arange(len(row)), best] = 0
            apart = np.maximum(apart, bound[:, None])
            for child, near in enumerate((apart <= margin).T):
                at = np.flatnonzero(near)
                if len(at):
                    queue.append((int(children[child]), row[at], apart[at, child]))
        rows, leaves = np.concatenate([r for r, _, _ in out]), np.repeat([leaf for _, leaf, _ in out], [len(r) for r, _, _ in out])
        bounds = np.concatenate([b for _, _, b in out])
        order = np.lexsort((leaves, bounds, rows))
        return rows[order], leaves[order], bounds[order]


def radius(similarity: float) -> float:
    """The distance of unit vectors of that cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * similarity)))


def calibrate(tree: Tree, x: np.ndarray, k: int, min_similarity: float | None, recall: float) -> float:
    """Leaf visits are widened until pairs meet in a leaf often enough: the least margin that finds the share ``recall`` of the probes.

    Probes are pairs of sample vectors with their neighbours in the sample, and, where a least similarity is
    set, of sample vectors with random ones at just that similarity: the hardest pairs that count. Of two
    vectors no further apart than ``r``, one lies within ``r / 2`` of the plane between their cells, so that
    margin finds every pair and is the most ever used.
    """
    if not tree.centres:
        return 0.0
    rng = np.random.default_rng(3)
    near = x[:500] @ x.T
    near[np.arange(len(near)), np.arange(len(near))] = -2
    top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    rows = np.repeat(np.arange(len(near)), top.shape[1])
    kept = near[rows, top.ravel()] >= (-2 if min_similarity is None else min_similarity)
    left, right = x[rows[kept]], x[top.ravel()[kept]]
    # Of unit vectors no plane is further away than 2: there every leaf is visited.
    limit = 2.0
    if min_similarity is not None:
        limit = radius(min_similarity) / 2
        base = x[rng.choice(len(x), min(len(x), 4000), replace=False)]
        away = rng.standard_normal(base.shape).astype(np.float32)
        away -= (away * base).sum(axis=1, keepdims=True) * base
        away /= np.linalg.norm(away, axis=1, keepdims=True)
        other = min_similarity * base + np.sqrt(1 - min_similarity**2) * away
        left, right = np.vstack([left, base]), np.vstack([right, other.astype(np.float32)])
    n, leaves = len(left), len(tree.leaf_share)
    margin = limit / 8
    while True:
        # A pair meets in a leaf from the larger of its two bounds on, and needs the least of its leaves.
        (a, leaf_a, far_a), (b, leaf_b, far_b) = (tree.search(side, margin) for side in (left, right))
        _, i, j = np.intersect1d(a * leaves + leaf_a, b * leaves + leaf_b, assume_unique=True, return_indices=True)
        needed = np.full(n, np.inf)
        np.minimum.at(needed, a[i], np.maximum(far_a[i], far_b[j]))
        enough = float(np.sort(needed)[max(0, int(np.ceil(recall * n)) - 1)]) if n else 0.0
        if enough <= margin or margin >= limit:
            return min(enough + 1e-6, limit)
        margin = min(2 * margin, limit)


def _visits(trees: dict[str, tuple[Tree, float, np.ndarray]]):
    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column("model").to_pylist(), object)
            for model in dict.fromkeys(models.tolist()):
                # A model the sample didn't have is one leaf, which its task divides if it is large.
                tree, margin, blocks = trees.get(model) or (Tree([], [], np.ones(1)), 0.0, np.ones(1, np.int64))
                own = batch.take(pa.array(np.flatnonzero(models == model)))
                rows, leaves = tree.visit(unpack(own.column("packed")), margin)
                # A leaf too large for one task is worked on as all pairs of its blocks.
                n = blocks[leaves]
                ids = own.column("id").to_numpy()[rows].astype(np.uint64)
                mine = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                copy = np.repeat(np.arange(len(rows)), n)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                low, high = np.minimum(mine[copy], other), np.maximum(mine[copy], other)
                taken = own.take(pa.array(rows[copy]))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("model"), pa.array(leaves[copy].astype(np.int32)), pa.array((low * 100_000 + high).astype(np.int64)), taken.column("id"), taken.column("packed")],
                    names=["model", "leaf", "part", "id", "packed"],
                )

    return visits


def _cells(x: np.ndarray, k: int, least: float | None, recall: float, leaf_rows: int) -> Iterator[np.ndarray]:
    """Rows of one leaf to be compared with each other: all, or the leaves of a tree of its own where they are many.

    The tree's size follows from the rows there are, its margin from pairs of them, so that the share ``recall``
    meets again. Copies that no plane parts stay together.
    """
    if len(x) <= 4 * leaf_rows:
        yield np.arange(len(x))
        return
    sample = x[np.random.default_rng(17).choice(len(x), min(len(x), 8_192), replace=False)]
    tree = Tree.fit(sample, max(2, len(x) // (leaf_rows if least is None else max(1, leaf_rows // 8))))
    rows, leaves = tree.visit(x, calibrate(tree, sample, k, least, recall))
    order = np.argsort(leaves, kind="stable")
    for cell in np.split(rows[order], np.flatnonzero(np.diff(leaves[order])) + 1):
        yield np.sort(cell)


def _compare(k: int, min_similarity: float | None, recall: float, leaf_rows: int):
    least = -1.5 if min_similarity is None else min_similarity

    def compare(group: pa.Table) -> pa.Table:
        all_ids, order = np.unique(group.column("id").to_numpy(), return_index=True)
        vectors = unpack(group.column("packed"))[order]
        out_a, out_b, out_s = [], [], []
        for cell in _cells(vectors, k, min_similarity, recall, leaf_rows):
            ids, x = all_ids[cell], vectors[cell]
            for lo in range(0, len(x), 1024):
                s = x[lo : lo + 1024] @ x.T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
                if s.shape[1] > 4 * k and least < 0.5:
                    # The kth largest of a row is the least that can count; ties with it all stay for the final ranking by id.
                    floor = np.maximum(np.partition(s, -k, axis=1)[:, -k], least)
                else:
                    floor = np.full(len(s), least)
                a, b = np.divmod(np.flatnonzero(s >= floor[:, None] - 1e-6), s.shape[1])
                rank = np.lexsort((ids[b], -s[a, b], a))
                a, b = a[rank], b[rank]
                top = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b = a[top], b[top]
                out_a.append(ids[lo + a])
                out_b.append(ids[b])
                out_s.append(s[a, b])
        model = group.column("model")[0].as_py() if group.num_rows else ""
        a, b, s = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b, out_s))
        if len(out_a) > 1:
            # Pairs that met in several cells go on once, and no more than a row can need.
            rank = np.lexsort((-s, b, a))
            a, b, s = a[rank], b[rank], s[rank]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            a, b, s = a[new], b[new], s[new]
            rank = np.lexsort((b, -s, a))
            a, b, s = a[rank], b[rank], s[rank]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            a, b, s = a[top], b[top], s[top]
        return pa.table({
            "model": pa.array([model] * len(a), pa.string()), "id": pa.array(a, pa.int64()),
            "neighbour": pa.array(b, pa.int64()), "similarity": pa.array(s.astype(np.float64)),
        })

    return compare


def index_sample(counted: DataFrame, vectors: DataFrame, sample: int = 20_000) -> tuple[dict[str, int], pa.Table]:
    """Rows of each model in ``counted``, and of ``vectors`` at most ``sample`` a model, chosen by a hash of their ids."""
    counts = {r.model: r.n for r in counted.where("model is not null").groupBy("model").agg(F.count("*").alias("n")).collect()}
    # A first cut by hash keeps the ranked rows near the sample's size at any scale.
    shares = [F.when(F.col("model") == m, min(1.0, 1.5 * sample / n)) for m, n in counts.items()]
    likely = vectors.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).where(F.col("h") < F.coalesce(*shares, F.lit(1.0)) * float(1 << 40))
    order = Window.partitionBy("model").orderBy("h", "id")
    return counts, likely.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("model", "packed").toArrow()


def most_similar(
    vectors: DataFrame, k: int, min_similarity: float | None = None, recall: float = 0.995, sample: int = 20_000, leaf_rows: int = 2_000, max_leaves: int = 4_096, block: int = 100_000, task_rows: int = 75_000,
    fitted: tuple[dict[str, int], pa.Table] | None = None,
) -> DataFrame:
    """The ``k`` most similar other vectors of the same model for every vector: ``model``, ``id``, ``neighbour``, ``similarity``, ``rank``.

    ``vectors`` has ``model``, ``id`` (unique, bigint) and ``packed`` (see ``vectors.packed``); rows with a
    null are left out, ids that occur twice count once, other columns are ignored. Ties are ranked by
    ``neighbour``. An empty table gives an empty result. With ``min_similarity`` only pairs of that cosine.

    Each model's tree is fitted on at most ``sample`` rows, chosen by hash, and aims at one leaf for
    ``leaf_rows`` rows, from 64 leaves on at one for ``task_rows``, and at ``max_leaves`` at most, so what is sent
    to the executors is bounded by some thousand centres, and rows go to few leaves. Every row goes to its own
    leaf and all within the calibrated margin. A leaf of many rows is divided by a tree of its own within its
    task, whose margin is calibrated, too, so the cost of a row does not grow with their number; one estimated
    to hold more than ``block`` is split into blocks, each pair of which is a task. Half of the pairs that
    may be missed is allowed to this tree, and a hundredth to those of the leaves.
    ``fitted`` is what ``index_sample`` made of a cheaper table with about the same vectors.
    """
    rows = vectors.where("model is not null and id is not null and packed is not null").select("model", F.col("id").cast("long").alias("id"), "packed")
    counts, taken = fitted or index_sample(rows, rows, sample)
    trees: dict[str, tuple[Tree, float, np.ndarray]] = {}
    names = np.array(taken.column("model").to_pylist(), object)
    for model, n in counts.items():
        if not (names == model).any():
            n, x = 0, np.zeros((0, 1), np.float32)
        else:
            x = unpack(taken.filter(pa.array(names == model)).column("packed"))
        tree = Tree.fit(x, int(np.clip(min(np.ceil(n / leaf_rows), max(64, np.ceil(n / task_rows))), 1, max_leaves)))
        margin = calibrate(tree, x, k, min_similarity, 1 - 0.5 * (1 - recall))
        # As many rows as the leaf's share of the sample lets expect, and two standard deviations more.
        drawn = tree.leaf_share * len(x)
        blocks = np.maximum(1, np.ceil((drawn + 2 * np.sqrt(drawn)) / max(1, len(x)) * n / block)).astype(np.int64)
        trees[model] = tree, margin, blocks
    visited = rows.mapInArrow(_visits(trees), "model string, leaf int, part bigint, id bigint, packed binary")
    pairs = visited.groupBy("model", "leaf", "part").applyInArrow(
        _compare(k, min_similarity, 1 - 0.01 * (1 - recall), leaf_rows), "model string, id bigint, neighbour bigint, similarity double"
    )
    once = pairs.groupBy("model", "id", "neighbour").agg(F.max("similarity").alias("similarity"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("model", "id").orderBy(F.desc("similarity"), "neighbour")))
    return ranked.where(F.col("rank") <= k)
