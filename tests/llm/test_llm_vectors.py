"""Neighbours and clusters against brute force."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnloom.llm import clusters, neighbours, vectors


def frame(spark, x, model="m"):
    rows = [(i, model, v.tolist()) for i, v in enumerate(x)]
    return vectors.packed(spark.createDataFrame(rows, "id bigint, model string, v array<float>"), "v")


def voices(seed=0, groups=12, n=40, dim=32, noise=0.10):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, n, axis=0) + r.standard_normal((groups * n, dim)) * noise
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.repeat(np.arange(groups), n)


def test_packing_is_close():
    x, _ = voices()
    back = vectors.unpack(vectors.binary(vectors.pack(x)))
    assert np.abs(back @ back.T - x @ x.T).max() < 1e-4
    assert vectors.unpack(pa.array([], pa.binary())).shape[0] == 0


def test_usable(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert {r.id for r in df.where(vectors.is_usable(F.col("v"), F.lit(2))).collect()} == {0, 6}


def test_every_neighbour_above_a_similarity(spark):
    x, _ = voices(1)
    r = np.random.default_rng(2)
    twins = x[:60] + r.standard_normal((60, x.shape[1])) * 0.01
    x = np.vstack([x, twins / np.linalg.norm(twins, axis=1, keepdims=True), x[:3], x[:3]]).astype(np.float32)
    found = neighbours.most_similar(frame(spark, x), 5, 0.97, leaf_rows=40, block=30, sample=300).collect()
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -np.round(s[i], 5)))[:5] if s[i, j] >= 0.97}
    got = {(r.id, r.neighbour) for r in found}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_recall_without_a_limit(spark):
    x, _ = voices(3, groups=20, n=60)
    found = neighbours.most_similar(frame(spark, x), 5, None, recall=0.97, leaf_rows=150, sample=800).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = {(r.id, r.neighbour) for r in found}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_leaves_come_as_from_a_queue_of_each_row():
    x = voices(14, groups=60, n=20)[0].astype(np.float32)
    tree = neighbours.Tree.fit(x, 80)
    rows, leaves, bounds = tree.search(x[:100], 0.15)
    for i in range(100):
        queue, want = [(0.0, 0)], []
        while queue:
            bound, node = heapq.heappop(queue)
            if node < 0:
                want.append((round(bound, 4), -1 - node))
                continue
            centres = tree.centres[node].astype(float)
            far = ((x[i] - centres) ** 2).sum(axis=1)
            best = int(far.argmin())
            for c, child in enumerate(tree.children[node].tolist()):
                apart = bound if c == best else max(bound, (far[c] - far[best]) / (2 * np.linalg.norm(centres[c] - centres[best])))
                if apart <= 0.15:
                    heapq.heappush(queue, (apart, child))
        own = rows == i
        assert set(leaves[own].tolist()) == {leaf for _, leaf in want}
        assert np.abs(np.sort(bounds[own]) - [b for b, _ in want]).max() < 1e-3 and (np.diff(bounds[own]) >= 0).all()


def test_leaves_of_many_rows_cost_little_and_lose_nothing():
    x = voices(15, groups=3_000, n=8, dim=64, noise=0.08)[0]
    r = np.random.default_rng(16)
    twins = x[:3_000] + r.standard_normal((3_000, 64)) * 0.02
    x = np.vstack([x, twins / np.linalg.norm(twins, axis=1, keepdims=True)]).astype(np.float32)
    cells = list(neighbours._cells(x, 5, 0.97, 0.9995, 2_000))
    # All pairs of the leaf are 729 million.
    assert sum(len(c) ** 2 for c in cells) < len(x) ** 2 / 12
    homes = [set() for _ in x]
    for n, cell in enumerate(cells):
        for i in cell.tolist():
            homes[i].add(n)
    met = [bool(homes[i] & homes[24_000 + i]) for i in range(3_000) if x[i] @ x[24_000 + i] >= 0.97]
    assert len(met) > 1_000 and np.mean(met) >= 0.999


def test_neighbours_empty_and_two_models(spark):
    empty = frame(spark, np.zeros((0, 4))).where("false")
    assert neighbours.most_similar(empty, 5, 0.9).collect() == []
    x, _ = voices(4, groups=2, n=3)
    both = frame(spark, x, "a").unionByName(frame(spark, x[:, :16], "b").withColumn("id", F.col("id") + 100))
    assert all((r.id < 100) == (r.neighbour < 100) for r in neighbours.most_similar(both, 2, -1.0).collect())


def test_clusters_are_the_voices(spark):
    x, truth = voices(5, groups=10, n=30, noise=0.07)
    lone = np.random.default_rng(6).standard_normal((5, x.shape[1]))
    x = np.vstack([x, lone, x[:2]])
    found = clusters.similarity_clusters(frame(spark, x).repartition(3), 0.78).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(r.id)
        assert r.cosine >= 0.78
    want = {frozenset(np.flatnonzero(truth == g).tolist() + [300 + 5 + i for i in range(2) if truth[i] == g]) for g in range(10)}
    assert {frozenset(g) for g in groups.values()} == want
    assert all(min(g) == c for c, g in groups.items()) and all(r.size == len(groups[r.cluster]) for r in found)
    described = clusters.describe_clusters(spark.createDataFrame(found)).collect()
    assert len(described) == 10 and all(len(d.typical) == 5 and set(d.typical) <= groups[d.cluster] for d in described)


def test_small_voices_among_many_unrelated_vectors(spark):
    x, truth = voices(7, groups=40, n=3, dim=64, noise=0.06)
    noise = np.random.default_rng(8).standard_normal((10_000, 64))
    x = np.vstack([x, noise / np.linalg.norm(noise, axis=1, keepdims=True)])
    order = np.random.default_rng(9).permutation(len(x))
    groups = {}
    for r in clusters.similarity_clusters(frame(spark, x[order]).repartition(3), 0.78).collect():
        groups.setdefault(r.cluster, set()).add(int(order[r.id]))
    kept = [g for g in range(40) if set(np.flatnonzero(truth == g).tolist()) in groups.values()]
    assert len(kept) == 40


def test_prototypes_of_many_slabs_are_joined(spark):
    # 200 slabs' prototypes of 10 voices: few are left to be linked, none of two voices, and all weight is kept.
    x, truth = voices(17, groups=10, n=200, noise=0.02)
    nodes = frame(spark, x).withColumn("n", F.lit(5).cast("long")).withColumn("direction", F.lit(None).cast("int"))
    way = dict(enumerate(clusters.longest_direction(x.astype(np.float32)).tolist()))
    ways = spark.createDataFrame(list(way.items()), "id bigint, direction int")
    rows = clusters.join_prototypes(nodes.drop("direction").join(ways, "id")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, []).append(r.id)
    assert len(rows) == 2_000 and len(groups) <= 60 and all(min(g) == c for c, g in groups.items())
    assert all(len({int(truth[i]) for i in g}) == 1 for g in groups.values())


def test_clusters_of_nothing(spark):
    assert clusters.similarity_clusters(frame(spark, np.zeros((0, 8))).where("false"), 0.78).collect() == []


def test_large_buckets_keep_their_links():
    r = np.random.default_rng(9)
    base = r.standard_normal((2, 32))
    x = np.repeat(base / np.linalg.norm(base, axis=1, keepdims=True), 50, axis=0).astype(np.float32)
    sets = clusters.direction_sets(x)
    table = pa.table({
        "model": pa.array(["m"] * 100), "band": pa.array([0] * 100, pa.int32()), "key": pa.array([1] * 100, pa.int64()), "id": pa.array(range(100), pa.int64()),
        "tokens": vectors.binary(sets.astype("<i2").view(np.uint8)),
    })
    links = pa.Table.from_batches(clusters._verified(0.9, 16)(table.to_batches()))
    seen = {(min(a, b), max(a, b)) for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist())}
    assert len(seen) == 98 and all(a // 50 == b // 50 for a, b in seen)


def sets_of(*rows):
    """Token sets of the size the operator has: a row states which of four blocks of tokens it has, and how many of each."""
    out = []
    for row in rows:
        own = [64 * block + i for block, n in row for i in range(n)]
        assert len(own) == clusters.TOKENS
        out.append(sorted(own))
    return np.array(out)


def linked(sets, jaccard, block=1024):
    return {tuple(sorted(x)) for x in clusters.bucket_links(sets, jaccard, block)}


def test_a_row_between_two_classes_keeps_both_links():
    # A and B share half of their tokens with r, and few with each other.
    a, b, r = sets_of([(0, 18), (1, 6)], [(0, 6), (2, 18)], [(0, 18), (1, 0), (2, 6)])
    b = np.array(sorted([*range(12, 18), *range(128, 146)]))
    r = np.array(sorted([*range(3, 18), *range(128, 137)]))
    sets = np.stack([a, b, r])
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert jac(a, r) >= 0.35 and jac(b, r) >= 0.35 and jac(a, b) < 0.35
    assert linked(sets, 0.35) == {(0, 2), (1, 2)}
    # A and m in one block, z in the next: z is similar to m only.
    sets = np.stack([a, r, b])
    assert linked(sets, 0.35, block=2) == {(0, 1), (1, 2)}


def test_links_against_all_pairs():
    r = np.random.default_rng(12)
    for _ in range(30):
        sets = np.sort(np.stack([r.choice(40, clusters.TOKENS, replace=False) for _ in range(r.integers(2, 60))]), axis=1)
        sets = np.vstack([sets, sets[:2]])
        share = np.array([[len(set(x) & set(y)) for y in sets] for x in sets])
        want = share / (2 * clusters.TOKENS - share) >= 0.5
        links = clusters.bucket_links(sets, 0.5, block=16)
        assert all(want[i, j] for i, j in links)

        def parts(pairs):
            home = list(range(len(sets)))
            for i, j in pairs:
                a, b = home[i], home[j]
                home = [min(a, b) if h in (a, b) else h for h in home]
            return home

        assert parts(links) == parts(np.argwhere(np.triu(want, 1)).tolist())
        got = {(int(i), int(j)) for i, j in links}
        assert all(any((i, x) in got or (x, i) in got for x in range(len(sets))) for i in range(len(sets)) if want[i].sum() > 1)


def test_large_buckets_keep_every_link(spark):
    r = np.random.default_rng(13)
    sets = np.unique(np.sort(np.stack([r.choice(40, clusters.TOKENS, replace=False) for _ in range(60)]), axis=1), axis=0)
    share = np.array([[len(set(x) & set(y)) for y in sets] for x in sets])
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(share / (2 * clusters.TOKENS - share) >= 0.5, 1))}
    assert linked(sets, 0.5, block=16) == want
    # 40 copies of one vector and 3 near it: every pair, too.
    x = np.repeat(r.standard_normal((1, 32)), 43, axis=0)
    x[40:] += r.standard_normal((3, 32)) * 0.05
    found = {(min(l.a, l.b), max(l.a, l.b)) for l in clusters.similar_links(frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), clusters.BANDS, 2, 0.2).collect()}
    assert found == {(i, j) for i in range(43) for j in range(i + 1, 43)}


def test_banding_meets_similar_sets():
    r = np.random.default_rng(3)
    base = r.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = r.standard_normal(base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x, y = (clusters.direction_sets(v) for v in (base, 0.8 * base + 0.6 * away))
    a, b = (clusters.band_keys(v, clusters.BANDS, 2) for v in (x, y))
    met = (a == b).any(axis=1)
    share = np.array([len(set(i) & set(j)) / len(set(i) | set(j)) for i, j in zip(x, y)])
    assert (share >= 0.3).sum() > 100 and met[share >= 0.3].mean() >= 0.99 and met[share >= 0.2].mean() >= 0.97
