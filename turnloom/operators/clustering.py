"""Clustering of a session's utterances: density clusters, assignment to known speakers, online and adaptive labels.

The kernels are numpy over one session's utterances. No N x N matrix is held: the final clusters of a long session
are found by distances of one row or block at a time, in time that grows with the square of its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LETTERS
from ..functions.vector import centroids
from ..session import cut
from .assignment import assign
from .joins import nearest_vector

# The settings that are compared, with tau_active, rho_update, delta_new and the passes after the stream.
SCHEDULERS = {
    "baseline": (0.6, 0.3, 1.0, ()),
    "decay-A": (0.5, 0.5, 0.8, ()),
    "decay-B": (0.7, 0.1, 1.2, ()),
    "hdbscan-off": (0.6, 0.3, 1.0, ()),
    "hdbscan-on": (0.6, 0.3, 1.0, ("final",)),
    "legacy-adaptive": (0.6, 0.3, 1.0, ("adaptive",)),
    "legacy-final": (0.6, 0.3, 1.0, ("final",)),
    "legacy-both": (0.6, 0.3, 1.0, ("adaptive", "final")),
}


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n < 1e-9, 1.0, n)


def distances(x: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows, at least 0, with a zero diagonal."""
    d = np.maximum(1 - x @ x.T, 0.0)
    np.fill_diagonal(d, 0.0)
    return d


def _spanning_tree(weights: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning tree (Prim), ascending by weight, then ends."""
    n = len(weights)
    reach, via, left = weights[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    edges = []
    for _ in range(n - 1):
        near = int(np.argmin(np.where(left, reach, np.inf)))
        edges.append((float(reach[near]), int(via[near]), near))
        left[near] = False
        closer = left & (weights[near] < reach)
        reach[closer], via[closer] = weights[near][closer], near
    return sorted(edges, key=lambda e: (e[0], min(e[1:]), max(e[1:])))


def _spanning_tree_of_rows(x: np.ndarray, min_samples: int, block: int = 256) -> list[tuple[float, int, int]]:
    """The edges ``_spanning_tree`` gives for the mutual reachability of unit rows, without their distance matrix."""
    n = len(x)
    core, k = np.empty(n), min(min_samples, n - 1)
    for lo in range(0, n, block):
        d = np.maximum(1 - x[lo : lo + block] @ x.T, 0.0)
        d[np.arange(len(d)), lo + np.arange(len(d))] = 0.0
        core[lo : lo + block] = np.partition(d, k, axis=1)[:, k]
    # What is left to reach, in order, and its rows; they are packed together as they become fewer.
    left, rows, inner = np.arange(1, n), x[1:], core[1:]
    reach, via, open_ = np.full(n - 1, np.inf), np.zeros(n - 1, int), np.ones(n - 1, bool)
    at, edges = 0, []
    for step in range(n - 1):
        weights = np.maximum(np.maximum(1 - rows @ x[at], 0.0), np.maximum(inner, core[at]))
        closer = open_ & (weights < reach)
        reach[closer], via[closer] = weights[closer], at
        near = int(np.argmin(reach))
        at = int(left[near])
        edges.append((float(reach[near]), int(via[near]), at))
        open_[near], reach[near] = False, np.inf
        if 2 * (n - 2 - step) < len(left) and len(left) > block:
            left, rows, inner, reach, via, open_ = (v[open_] for v in (left, rows, inner, reach, via, open_))
    return sorted(edges, key=lambda e: (e[0], min(e[1:]), max(e[1:])))


def _cross_edges(x: np.ndarray, y: np.ndarray, tree_x: list[tuple[float, int, int]], tree_y: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Edges between ``x`` and ``y`` (rows of each) of a minimum spanning tree of both, from the trees of each (Prim over the rest)."""
    n, total = len(x), len(x) + len(y)
    d = x @ y.T
    np.subtract(1, d, out=d)
    np.maximum(d, 0.0, out=d)
    turned = np.ascontiguousarray(d.T)
    inner: list[list[tuple[float, int]]] = [[] for _ in range(total)]
    for w, a, b in [*tree_x, *((w, a + n, b + n) for w, a, b in tree_y)]:
        inner[a].append((w, b))
        inner[b].append((w, a))
    reach, via, open_ = np.full(total, np.inf), np.zeros(total, int), np.ones(total, bool)
    sides = [(reach[n:], via[n:], open_[n:], np.empty(total - n, bool)), (reach[:n], via[:n], open_[:n], np.empty(n, bool))]
    at, edges = 0, []
    for _ in range(total - 1):
        open_[at], reach[at] = False, np.inf
        weights = d[at] if at < n else turned[at - n]
        far, how, there, closer = sides[at >= n]
        np.less(weights, far, out=closer)
        closer &= there
        np.putmask(far, closer, weights)
        np.putmask(how, closer, at)
        for w, b in inner[at]:
            if open_[b] and w < reach[b]:
                reach[b], via[b] = w, at
        near = int(reach.argmin())
        last = int(via[near])
        if (near < n) != (last < n):
            edges.append((float(reach[near]), min(near, last), max(near, last) - n))
        at = near
    return edges


def _least_edges(n: int, edges: np.ndarray) -> np.ndarray:
    """Of ``edges`` (rows of weight, a, b) those of a minimum spanning forest of ``n`` points (Kruskal); ties by their ends."""
    low, high = edges[:, 1:].min(axis=1), edges[:, 1:].max(axis=1)
    edges = edges[np.lexsort((high, low, edges[:, 0]))]
    parent, kept = list(range(n)), []
    for i, (a, b) in enumerate(edges[:, 1:].astype(int).tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[a] = b
            kept.append(i)
    return edges[kept]


def _block_edges(x: np.ndarray, n: int, block: int = 2_000) -> np.ndarray:
    """Edges (weight, a, b) that a minimum spanning tree of unit rows may take, block by block.

    With ``n`` = ``len(x)`` they are those of the rows' own tree, else the ones between the first ``n`` and the others.
    An edge of the tree of all rows is one of every tree of some rows that have both its ends, so trees of pairs of blocks miss none.
    """
    starts = [*range(0, n, block), *range(n, len(x), block)]
    stops = [min(s + block, n if s < n else len(x)) for s in starts]
    trees = [_spanning_tree(distances(x[a:b])) if b - a > 1 else [] for a, b in zip(starts, stops)]
    whole = n == len(x)
    kept = np.array([(w, a + s, b + s) for s, tree in zip(starts, trees) for w, a, b in tree] if whole else [], float).reshape(-1, 3)
    for i, a in enumerate(starts):
        found = [kept]
        for k in range(i + 1, len(starts)):
            b = starts[k]
            if whole or (a < n <= b):
                edges = np.array(_cross_edges(x[a : stops[i]], x[b : stops[k]], trees[i], trees[k]), float).reshape(-1, 3)
                found.append(edges + [0, a, b])
        if len(found) > 1:
            kept = _least_edges(len(x), np.concatenate(found))
    return kept


def hdbscan_of_rows(x: np.ndarray, min_cluster_size: int = 2, min_samples: int = 1, epsilon: float = 0.3) -> np.ndarray:
    """``hdbscan`` of the cosine distances of unit rows, in memory in proportion to their number."""
    if len(x) < 2 or len(x) < min_cluster_size:
        return np.full(len(x), -1)
    # With one sample the core of a row is its nearest one, so that reachability is the distance.
    edges = _sorted_edges(_block_edges(x, len(x))) if min_samples == 1 else _spanning_tree_of_rows(x, min_samples)
    return _tree_clusters(len(x), edges, min_cluster_size, epsilon)


def _sorted_edges(edges: np.ndarray) -> list[tuple[float, int, int]]:
    return sorted(((w, int(a), int(b)) for w, a, b in edges.tolist()), key=lambda e: (e[0], min(e[1:]), max(e[1:])))


def hdbscan(d: np.ndarray, min_cluster_size: int = 2, min_samples: int = 1, epsilon: float = 0.3) -> np.ndarray:
    """Density-based clusters of a distance matrix: labels from 0, noise -1.

    Mutual reachability, its spanning tree, the tree condensed to clusters of ``min_cluster_size``, clusters
    of largest stability; those split below ``epsilon`` are merged back into the ancestor that reaches it
    (Campello et al. 2013; Malzer & Baum 2020). The root is never a cluster, so one tight group is all noise.
    """
    n = len(d)
    if n < 2 or n < min_cluster_size:
        return np.full(n, -1)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    return _tree_clusters(n, _spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None]))), min_cluster_size, epsilon)


def _tree_clusters(n: int, edges: list[tuple[float, int, int]], min_cluster_size: int, epsilon: float) -> np.ndarray:
    """The labels of ``hdbscan`` from the spanning tree of ``n`` points."""
    # Single linkage: nodes n.. join two others at a distance.
    parent, joins = list(range(n)), []
    sizes = [1] * n

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for w, a, b in edges:
        ra, rb = root(a), root(b)
        new = n + len(joins)
        joins.append((ra, rb, w))
        parent.append(new)
        sizes.append(sizes[ra] + sizes[rb])
        parent[ra] = parent[rb] = new

    def members(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [joins[x - n][1], joins[x - n][0]]
        return out

    # Condensed tree: clusters with the density at which they appear, and where points and children leave.
    born, up, stability, leaves = [0.0], [-1], [0.0], {0: []}
    held: list[list[int]] = [list(range(n))]
    stack = [(n + len(joins) - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        a, b, w = joins[node - n]
        density = 1 / max(w, 1e-12)
        big = [x for x in (a, b) if sizes[x] >= min_cluster_size]
        for x in (a, b):
            if len(big) == 2:
                child = len(born)
                born.append(density)
                up.append(cluster)
                stability.append(0.0)
                leaves[child] = []
                leaves[cluster].append(child)
                held.append(members(x))
                stack.append((x, child))
            elif x in big:
                stack.append((x, cluster))
            stability[cluster] += sizes[x] * (density - born[cluster]) if x not in big or len(big) == 2 else 0.0
    chosen = {c: not leaves[c] for c in range(len(born))}
    best = stability[:]
    for c in range(len(born) - 1, 0, -1):
        below = sum(best[x] for x in leaves[c])
        if leaves[c] and below > stability[c]:
            best[c] = below
        else:
            chosen[c] = True
    chosen[0] = False
    picked: list[int] = []
    stack_c = list(leaves[0])
    while stack_c:
        c = stack_c.pop(0)
        if chosen[c]:
            picked.append(c)
        else:
            stack_c += leaves[c]
    # Clusters that appear only below epsilon go back to the first ancestor that doesn't.
    final: list[int] = []
    for c in picked:
        while 1 / born[c] < epsilon and up[c] > 0:
            c = up[c]
        final.append(c)
    labels = np.full(n, -1)
    keep = [c for c in dict.fromkeys(final) if not any(o != c and set(held[c]) < set(held[o]) for o in final)]
    for i, c in enumerate(sorted(keep, key=lambda c: min(held[c]))):
        labels[held[c]] = i
    return labels


def absorb_noise(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Noise goes to the nearest cluster centre; if all is noise, all is one cluster."""
    if (labels == -1).all():
        return np.zeros(len(labels), int)
    out = labels.copy()
    names = np.unique(labels[labels >= 0])
    centres = unit_rows(np.stack([x[labels == c].mean(axis=0) for c in names]))
    noise = np.flatnonzero(labels == -1)
    out[noise] = names[np.argmax(x[noise] @ centres.T, axis=1)]
    return out


def issue_letters(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, known: dict[str, np.ndarray], accept: float = 0.5) -> dict[int, str]:
    """A label ``auto:<letter>`` for each cluster: that of the known centre assigned to it at a distance up to ``accept``, else the next free letter.

    Clusters take letters in the order in which they first appear; more than 20 are an error.
    """
    names = list(dict.fromkeys(labels.tolist()))
    if len(names) > len(LETTERS):
        raise RuntimeError(f"{len(names)} clusters, but only {len(LETTERS)} letters")
    centres = unit_rows(np.stack([np.average(x[labels == c], axis=0, weights=weights[labels == c]) for c in names]))
    letters = sorted(known)
    out: dict[int, str] = {}
    if letters:
        cost = np.maximum(1 - centres @ unit_rows(np.stack([known[k] for k in letters])).T, 0.0)
        out = {names[r]: letters[c] for r, c in assign(cost) if cost[r, c] <= accept}
    free = [f"auto:{ch}" for ch in LETTERS if f"auto:{ch}" not in out.values() and f"auto:{ch}" not in known]
    free += [f"auto:{ch}" for ch in LETTERS if f"auto:{ch}" in known and f"auto:{ch}" not in out.values()]
    for name in names:
        if name not in out:
            out[name] = free.pop(0)
    return out


def _voices(w: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, least: float) -> np.ndarray:
    """Numbers of the groups that edges below ``least`` join, of ``n`` points."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(w < least).tolist():
        parent[root(int(a[i]))] = root(int(b[i]))
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def _heights(n: int, edges: np.ndarray) -> np.ndarray:
    """The longest edge on each point's way through a spanning tree (rows of weight, a, b, ascending) to a point of its dense core.

    Two points' way is no longer than the larger of their heights, so that a longer edge between them is in no minimum spanning tree.
    """
    parent, sizes, joins = list(range(n)), [1] * n, []
    for w, a, b in edges.tolist():
        ends = []
        for i in (int(a), int(b)):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            ends.append(i)
        joins.append((*ends, w))
        sizes.append(sizes[ends[0]] + sizes[ends[1]])
        parent[ends[0]] = parent[ends[1]] = len(parent)
        parent.append(len(parent))
    out, node = np.zeros(n), len(parent) - 1
    while node >= n:
        x, y, w = joins[node - n]
        node, small = (x, y) if sizes[x] >= sizes[y] else (y, x)
        stack = [small]
        while stack:
            k = stack.pop()
            if k < n:
                out[k] = w
            else:
                stack += joins[k - n][:2]
    return out


def _edges_between(x: np.ndarray, y: np.ndarray, voice_x: np.ndarray, voice_y: np.ndarray, high_x: np.ndarray, high_y: np.ndarray, same: bool, block: int = 1_000, most: int = 2_000_000) -> np.ndarray:
    """Edges (weight, a, b; b counts on from ``x``'s rows) between unit rows of different voices that a minimum spanning tree may take.

    The rows are in the order of their voices. An edge longer than the ``high`` of both ends is in none (see ``_heights``);
    the others are found by products of single precision and weighed again in double. ``same``: ``y`` is ``x``, each pair comes once.
    """
    slack = 1e-5
    u, v = x.astype(np.float32), y.astype(np.float32)
    low_x, low_y = (1 - high_x - slack).astype(np.float32), (1 - high_y - slack).astype(np.float32)
    n = 0 if same else len(x)
    total = len(x) + (0 if same else len(y))
    found, count = [np.empty((0, 3))], 0
    for lo in range(0, len(x), block):
        hi = min(lo + block, len(x))
        names, first = np.unique(voice_x[lo:hi], return_index=True)
        last = np.append(first[1:], hi - lo)
        for start in range(lo if same else 0, len(y), 4 * block):
            stop = min(start + 4 * block, len(y))
            s = u[lo:hi] @ v[start:stop].T
            left, right = np.searchsorted(voice_y[start:stop], names), np.searchsorted(voice_y[start:stop], names, "right")
            for k in np.flatnonzero(left < right).tolist():
                s[first[k] : last[k], left[k] : right[k]] = -2
            hit = s > low_y[start:stop]
            hit |= s > low_x[lo:hi, None]
            i, j = np.divmod(np.flatnonzero(hit), stop - start)
            i, j = i + lo, j + start
            if same:
                i, j = i[i < j], j[i < j]
            w = np.maximum(1 - np.einsum("ij,ij->i", x[i], y[j]), 0.0)
            kept = w <= np.maximum(high_x[i], high_y[j]) + 1e-9
            found.append(np.column_stack([w[kept], i[kept], j[kept] + n]))
            count += int(kept.sum())
            if count > most:
                found = [_least_edges(total, np.concatenate(found))]
                count = 0
    return _least_edges(total, np.concatenate(found))


def spanning_edges(utterances: DataFrame, session: str = "session_id", id_: str = "utterance_id", vector: str = "embedding", most_alone: int = 4_000, most_part: int = 50_000, marks: int = 4_000, near: float = 0.4) -> DataFrame:
    """``session``, ``w``, ``a``, ``b``: edges that hold the minimum spanning tree of each session of more than ``most_alone`` unlocked rows.

    About ``marks`` rows of a session, joined below the distance ``near``, are its voices; every row is of the voice of its nearest mark.
    A tree of all rows has the edges of each voice's own tree and edges between voices. Own trees come first; with
    the marks' they bound what else is compared closely, so the result doesn't depend on ``marks`` and ``near``.
    Long voices, and the session for what is between voices, are cut into parts by hash, about 6 or as many as keep a part
    below ``most_part`` rows, and every pair of parts is a task of its own.
    """
    types = dict(utterances.dtypes)
    edge = f"`{session}` {types[session]}, w double, a {types[id_]}, b {types[id_]}"
    rows = utterances.where(~F.coalesce("is_locked", F.lit(False)) & F.col(vector).isNotNull()).select(session, F.col(id_).alias("__id"), F.col(vector).alias("__x"))
    n = F.col("__n")
    parts = F.greatest(F.ceil(n / most_part), F.least(F.lit(6), F.ceil(n / 1_000))).cast("int")
    large = rows.groupBy(session).agg(F.count("*").alias("__n")).where(n > most_alone)
    large = cut(large.select(session, "__n", parts.alias("__parts")))
    pairs = large.agg(F.sum(F.col("__parts") * (F.col("__parts") + 1) / 2)).first()[0]
    if not pairs:
        return utterances.sparkSession.createDataFrame([], edge)
    drawn = F.pmod(F.xxhash64("__id", F.lit("mark")), F.col("__n"))
    held = cut(rows.join(F.broadcast(large), session).withColumn("__part", F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int")))

    def vectors(part: pd.DataFrame) -> np.ndarray:
        return unit_rows(np.stack(part["__x"].to_numpy()).astype(float))

    def marked(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__id").head(2 * marks)
        tree = np.array(_spanning_tree(distances(vectors(part))), float).reshape(-1, 3) if len(part) > 1 else np.empty((0, 3))
        w, a, b = tree[:, 0], tree[:, 1].astype(int), tree[:, 2].astype(int)
        ids, far = part["__id"].to_numpy(), w >= near
        # Marks, then the edges between their voices (of voice -1, without a vector).
        voice, none, empty = _voices(w, a, b, len(part), near), np.full(int(far.sum()), -1), [np.empty(0)] * int(far.sum())
        parts = {"__id": (ids, ids[a[far]]), "__voice": (voice, none), "w": (np.zeros(len(ids)), w[far]), "b": (ids, ids[b[far]])}
        return pd.DataFrame({session: key[0], **{c: np.concatenate(v) for c, v in parts.items()}, "__x": [*part["__x"], *empty]})

    found = cut(held.where(drawn < marks).groupBy(session).applyInPandas(marked, f"`{session}` {types[session]}, __id {types[id_]}, __x {types[vector]}, __voice int, w double, b {types[id_]}"))
    bridges = found.where("__voice < 0").select(session, "w", F.col("__id").alias("a"), "b")
    sent = found.where("__voice >= 0").join(large, session).select(session, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "__x", "__voice")

    def placed_in(key: tuple, part: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame(columns=[session, "__part", "__id", "__x", "__voice"])
        voice = np.zeros(len(part), int)
        if len(given):
            x, m, names = vectors(part).astype(np.float32), vectors(given).astype(np.float32), given["__voice"].to_numpy(int)
            for lo in range(0, len(x), 2_000):
                voice[lo : lo + 2_000] = names[(x[lo : lo + 2_000] @ m.T).argmax(axis=1)]
        return part[[session, "__part", "__id", "__x"]].assign(__voice=voice)

    kept = held.select(session, "__part", "__id", "__x")
    placed = cut(kept.groupBy(session, "__part").cogroup(sent.groupBy(session, "__part")).applyInPandas(placed_in, f"`{session}` {types[session]}, __part int, __id {types[id_]}, __x {types[vector]}, __voice int"))

    def by_pairs(df: DataFrame, *by: str) -> DataFrame:
        met = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        met = met.withColumns({"__i": F.least("__part", "__other"), "__j": F.greatest("__part", "__other")}).drop("__other", "__parts")
        # Pairs are few bytes and long work: a given number of tasks isn't taken together by size.
        return met.repartition(min(1_000, 4 * int(pairs)), session, *by, "__i", "__j").groupBy(session, *by, "__i", "__j")

    def own(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__part", "__id"])
        ids, x = part["__id"].to_numpy(), vectors(part)
        edges = _block_edges(x, len(x) if key[2] == key[3] else int((part["__part"] == key[2]).sum()))
        a, b = edges[:, 1].astype(int), edges[:, 2].astype(int)
        return pd.DataFrame({session: key[0], "w": edges[:, 0], "a": ids[a], "b": ids[b]})

    few = F.greatest(F.ceil(n / most_part), F.least(F.lit(6), F.ceil(n / min(4_000, most_part)))).cast("int")
    voices = placed.groupBy(session, "__voice").agg(F.count("*").alias("__n")).select(session, "__voice", few.alias("__parts"))
    split = placed.drop("__part").join(voices, [session, "__voice"]).withColumn("__part", F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int"))
    inner = cut(by_pairs(split, "__voice").applyInPandas(own, edge))

    def bounded(key: tuple, tree: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if links.empty:  # one voice
            return pd.DataFrame(columns=[session, "__id", "__high"])
        tree = pd.concat([tree, links])
        at, ids = pd.factorize(pd.concat([tree.a, tree.b]))
        edges = _least_edges(len(ids), np.column_stack([tree.w, at[: len(tree)], at[len(tree) :]]).astype(float))
        return pd.DataFrame({session: key[0], "__id": ids, "__high": _heights(len(ids), edges)})

    high = inner.groupBy(session).cogroup(bridges.groupBy(session)).applyInPandas(bounded, f"`{session}` {types[session]}, __id {types[id_]}, __high double")

    def between(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__part", "__voice", "__id"])
        ids, x, voice, top = part["__id"].to_numpy(), vectors(part), part["__voice"].to_numpy(int), part["__high"].to_numpy(float)
        k = 0 if key[1] == key[2] else int((part["__part"] == key[1]).sum())
        first = slice(0, k or len(x))
        edges = _edges_between(x[first], x[k:], voice[first], voice[k:], top[first], top[k:], key[1] == key[2])
        a, b = edges[:, 1].astype(int), edges[:, 2].astype(int)
        return pd.DataFrame({session: key[0], "w": edges[:, 0], "a": ids[a], "b": ids[b]})

    outer = by_pairs(placed.join(high, [session, "__id"]).join(large.select(session, "__parts"), session)).applyInPandas(between, edge)
    return inner.unionByName(outer)


def final_recluster(utterances: DataFrame, session: str = "session_id", id_: str = "utterance_id", vector: str = "embedding", epsilon: float = 0.3, max_rows: int | None = None, most_matrix: int = 1_000, edges: DataFrame | None = None) -> DataFrame:
    """Final labels of a session's unlocked utterances: ``session``, ``id_``, ``old_label``, ``label``, ``cluster``, ``noise``.

    ``utterances`` also has ``label``, ``is_locked``, ``t_start`` and ``t_end`` (seconds). Known centres are the
    means of the present auto labels. Locked rows and rows without a vector are left out; ties follow the
    order of ``t_start``, then ``id_``. A session is clustered whole; with more than ``most_matrix`` rows no distance
    matrix is held, and the tree of a long one is found by many tasks (``edges``: see ``spanning_edges``; found here, if not given). ``noise`` marks rows of no cluster that went to the nearest one. Where there are more clusters
    than letters, rows have their cluster and a null label. With
    ``max_rows`` a longer session is an error.
    """
    types = dict(utterances.dtypes)

    def run(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        rows = rows[~rows.is_locked.fillna(False).astype(bool) & rows[vector].notna()].sort_values(["t_start", id_])
        if max_rows is not None and len(rows) > max_rows:
            raise ValueError(f"session {key[0]}: {len(rows)} utterances; split it, or raise max_rows")
        empty = pd.DataFrame(columns=[session, id_, "old_label", "label", "cluster", "noise"])
        if rows.empty:
            return empty
        x = unit_rows(np.stack(rows[vector].to_numpy()).astype(float))
        least = max(2, len(x) // 20)
        if len(tree) and rows[id_].is_unique:
            at = pd.Index(rows[id_])
            found = _least_edges(len(x), np.stack([tree.w, at.get_indexer(tree.a), at.get_indexer(tree.b)], axis=1).astype(float))
            dense = _tree_clusters(len(x), _sorted_edges(found), least, epsilon)
        else:
            dense = hdbscan(distances(x), least, 1, epsilon) if len(x) <= most_matrix else hdbscan_of_rows(x, least, 1, epsilon)
        labels = absorb_noise(x, dense)
        length = np.maximum((rows.t_end - rows.t_start).to_numpy(float), 0)
        old = rows.label.fillna("").to_numpy(str)
        known = {o: x[old == o].mean(axis=0) for o in sorted(set(old)) if o.startswith("auto:")}
        letters: dict[int, str] = {}
        if len(set(labels.tolist())) <= len(LETTERS):
            letters = issue_letters(x, labels, np.where(np.nan_to_num(length) > 0, length, 1.0), known)
        return pd.DataFrame({session: key[0], id_: rows[id_], "old_label": rows.label, "label": [letters.get(c) for c in labels], "cluster": labels, "noise": dense < 0})

    kept = utterances.select(session, id_, vector, "label", "is_locked", "t_start", "t_end")
    edges = spanning_edges(utterances, session, id_, vector) if edges is None else edges
    both = kept.groupBy(session).cogroup(edges.groupBy(session))
    return both.applyInPandas(run, f"`{session}` {types[session]}, `{id_}` {types[id_]}, old_label string, label string, cluster int, noise boolean")


def adaptive_moves(utterances: DataFrame, centers: DataFrame, session: str, id_: str, label: str, vector: str, center: str, center_vector: str, delta_new: float = 1.0) -> DataFrame:
    """``session``, ``id_``, ``old_label``, ``new_label`` of the unlocked utterances whose nearest centre of the session has another label.

    ``utterances`` also has ``is_locked`` (null: not locked). A centre less similar than ``1 - delta_new``
    moves nothing; centres without length are none; ties go to the smaller label. Utterances without a label keep none.
    """
    sound = centers.where(F.exists(center_vector, lambda x: x != 0)).select(session, F.col(center).alias("new_label"), center_vector)
    free = utterances.where(~F.coalesce("is_locked", F.lit(False)) & F.col(label).isNotNull())
    found = nearest_vector(free, sound, id_, vector, "new_label", center_vector, 1 - delta_new, on=[session])
    rows = free.select(session, id_, F.col(label).alias("old_label")).join(found.select(id_, "new_label"), id_)
    return rows.where("old_label != new_label").select(session, id_, "old_label", "new_label")


def adaptive_changes(utterances: DataFrame, centers: DataFrame, session: str, id_: str, label: str, vector: str, center: str, center_vector: str, delta_new: float = 1.0) -> DataFrame:
    """One row for each change of labels of a session: ``session``, ``old_label``, ``new_label``, ``n``, ``ids`` in order, ``reason``."""
    moved = adaptive_moves(utterances, centers, session, id_, label, vector, center, center_vector, delta_new)
    return moved.groupBy(session, "old_label", "new_label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id_)).alias("ids")).withColumn("reason", F.lit("recluster"))


def post_pass(utterances: DataFrame, passes: tuple[str, ...], delta_new: float = 1.0, session: str = "session_id", id_: str = "utterance_id", vector: str = "embedding", edges: DataFrame | None = None) -> DataFrame:
    """``session``, ``id_``, ``old_label``, ``label`` after the ``passes`` in turn: ``adaptive`` to the means of the auto labels, ``final`` clustering.

    ``utterances`` and ``edges`` are what ``final_recluster`` takes. Locked rows keep their labels.
    """
    now = utterances
    for name in passes:
        if name == "adaptive":
            means = centroids(now.where(F.col("label").startswith("auto:")), [session, "label"], vector).select(session, F.col("label").alias("center"), "centroid")
            moved = adaptive_moves(now, means, session, id_, "label", vector, "center", "centroid", delta_new)
            new = moved.select(F.col(id_).alias("__id"), F.col("new_label").alias("__new"))
        elif name == "final":
            new = final_recluster(now, session, id_, vector, edges=edges).select(F.col(id_).alias("__id"), F.col("label").alias("__new"))
        else:
            raise ValueError(f"unknown pass {name!r}: adaptive or final")
        now = now.join(new, F.col(id_) == F.col("__id"), "left").withColumn("label", F.coalesce("__new", "label")).drop("__id", "__new")
    old = utterances.select(F.col(id_).alias("__id"), F.col("label").alias("old_label"))
    return now.join(old, F.col(id_) == F.col("__id")).select(session, id_, "old_label", "label")


class OnlineCenters:
    """Centres that grow with each window: sums of unit vectors, compared by cosine, at most ``most`` of them.

    A local speaker is active if its peak activity reaches ``tau_active``; others get no centre. Its mean
    activity must reach ``rho`` to found or move a centre.
    """

    def __init__(self, delta_new: float = 1.0, rho: float = 0.3, most: int = 20, tau_active: float = 0.0):
        self.delta_new, self.rho, self.most, self.tau_active = delta_new, rho, most, tau_active
        self.sums: list[np.ndarray] = []

    def assign(self, vectors: np.ndarray, activity: np.ndarray, peak: np.ndarray | None = None) -> list[int]:
        """Centre of each local speaker of a window (-1: none); an optimal assignment of close ones, new centres for long others, the nearest free for the rest."""
        out = [-1] * len(vectors)
        peak = activity if peak is None else peak
        usable = [i for i in range(len(vectors)) if peak[i] >= self.tau_active and np.isfinite(vectors[i]).all() and np.linalg.norm(vectors[i]) > 1e-9]
        if not usable:
            return out
        x = unit_rows(vectors[usable].astype(float))
        taken: set[int] = set()
        if self.sums:
            cost = 1 - x @ unit_rows(np.stack(self.sums)).T
            for r, c in assign(cost):
                if cost[r, c] < self.delta_new:
                    out[usable[r]] = c
                    taken.add(c)
        for k, i in enumerate(usable):
            if out[i] >= 0:
                continue
            if activity[i] >= self.rho and len(self.sums) < self.most:
                self.sums.append(np.zeros(x.shape[1]))
                out[i] = len(self.sums) - 1
                taken.add(out[i])
            elif self.sums:
                order = np.argsort(1 - unit_rows(np.stack(self.sums)) @ x[k], kind="stable")
                free = [int(c) for c in order if int(c) not in taken]
                if free:
                    out[i] = free[0]
                    taken.add(free[0])
        for k, i in enumerate(usable):
            if out[i] >= 0 and activity[i] >= self.rho:
                self.sums[out[i]] = self.sums[out[i]] + x[k]
        return out


def online_labels(windows: DataFrame, session: str, order: str, speaker: str, vector: str, activity: str, delta_new: float = 1.0, rho: float = 0.3, most: int = 20, tau_active: float = 0.0, peak: str | None = None) -> DataFrame:
    """Global speakers of local ones, window by window: ``session``, ``order``, ``speaker``, ``center``, ``label``.

    ``activity`` is the mean, ``peak`` the largest activity in the window (the mean, if not given). A fold over each session's windows in order: what a window gets depends on all before it.
    """
    types = dict(windows.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centers, out = OnlineCenters(delta_new, rho, most, tau_active), []
        for window, part in rows.sort_values([order, speaker]).groupby(order, sort=True):
            found = centers.assign(np.stack(part[vector].to_numpy()), part[activity].to_numpy(float), part[peak].to_numpy(float) if peak else None)
            out += [(key[0], window, s, c, f"auto:{LETTERS[c]}" if c >= 0 else None) for s, c in zip(part[speaker], found)]
        return pd.DataFrame(out, columns=[session, order, speaker, "center", "label"])

    kept = windows.select(session, order, speaker, vector, activity, *([peak] if peak else []))
    return kept.groupBy(session).applyInPandas(run, f"`{session}` {types[session]}, `{order}` {types[order]}, `{speaker}` {types[speaker]}, center int, label string")


def identify_phrases(phrases: DataFrame, session: str, order: str, vector: str, seconds: str, same: float = 0.42, update: float = 0.55, short: float = 0.3, known: str | None = None) -> DataFrame:
    """Labels of phrases as they come: ``session``, ``order``, ``label``, ``similarity``.

    A phrase shorter than ``short`` takes over the last label. Else a registered or stored speaker, if the
    column ``known`` names one (see ``three_tiers``), is the label. Else the nearest centre from ``same`` on gives
    its letter, or a new letter is issued; from ``update`` on the centre moves, by the phrase's length weight.
    """
    types = dict(phrases.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centres: list[np.ndarray] = []
        last: str | None = None
        out = []
        for r in rows.sort_values(order).to_dict("records"):
            length = float(r[seconds])
            if length < short and last is not None:
                out.append((key[0], r[order], last, None))
                continue
            if known and isinstance(r[known], str):
                last = r[known]
                out.append((key[0], r[order], last, None))
                continue
            v = unit_rows(np.asarray(r[vector], float)[None])[0]
            s = np.array([c @ v for c in centres])
            best = int(s.argmax()) if len(s) else -1
            if best >= 0 and s[best] >= same:
                if s[best] >= update:
                    w = 0.02 if length < 1 else 0.05 if length < 3 else 0.15
                    centres[best] = unit_rows(((1 - w) * centres[best] + w * v)[None])[0]
                last, similarity = f"auto:{LETTERS[best]}", float(s[best])
            elif len(centres) < len(LETTERS):
                centres.append(v)
                last, similarity = f"auto:{LETTERS[len(centres) - 1]}", None
            else:
                last, similarity = f"auto:{LETTERS[best]}", float(s[best])
            out.append((key[0], r[order], last, similarity))
        return pd.DataFrame(out, columns=[session, order, "label", "similarity"])

    kept = phrases.select(session, order, vector, seconds, *([known] if known else []))
    return kept.groupBy(session).applyInPandas(run, f"`{session}` {types[session]}, `{order}` {types[order]}, label string, similarity double")
