"""Centroid clustering against brute force in Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from assayer.llm import centroids
from assayer.llm.oracles import ORACLES

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster string, distance string"


def nearest(x, centres):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))[::-1]


def brute(rows, k, dims, rounds):
    kept = [(r[0], [math.floor(1024 * float(v)) for v in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dims and all(v is not None and math.isfinite(v) for v in r[1])]
    name = lambda v: hashlib.sha256(f"3:{v[0]}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda v: (v[0] is None, name(v), v[1]))[:k]]
    for _ in range(rounds):
        at = [nearest(x, centres)[0] for _, x in kept]
        for c in set(at):
            mine = [x for (_, x), a in zip(kept, at) if a == c]
            centres[c] = [sum(v) // len(mine) for v in zip(*mine)]
    near = [nearest(x, centres) for _, x in kept]
    inertia = [sum(d for c, d in near if c == i) for i in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(v, c, d, inertia[c], sum(inertia), digest[c]) for (v, _), (c, d) in zip(kept, near)]


def vectors(n, dims, seed=0, step=8):
    rng = random.Random(seed)
    out = [(i, [rng.randint(-step, step) / 1024 for _ in range(dims)], 1, "c", "c", "c") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [None] * dims, [nan] + [0.0] * (dims - 1), [inf] * dims, [0.0] * (dims + 1)]
    out += [(1000 + i, v, None, "c", "c", "c") for i, v in enumerate(odd)]
    # repeats under their own and under other ids, no id, negative fractions, large numbers
    return out + [out[0], (2000, *out[1][1:]), (None, *out[2][1:]), (2001, [-0.0003] * dims, 1, "c", "c", "c"), (2002, [3e5] * dims, 1, "c", "c", "c")]


@pytest.mark.parametrize("k, dims, rounds", [(8, 64, 10), (1, 2, 2), (40, 2, 4), (500, 3, 1)])
def test_clusters_match_brute_force(spark, k, dims, rounds):
    rows = vectors(300, dims)
    table = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in centroids.clusters(table, k, dims, rounds).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, k, dims, rounds), key=repr)


def test_empty_and_sql(spark):
    table = spark.createDataFrame(vectors(200, 64), SCHEMA)
    assert centroids.clusters(table.where("false")).collect() == []
    assert centroids.clusters(table.where("size(embedding) < 64")).collect() == []
    con = duckdb.connect()
    con.register("embeddings", table.where("vec_id IS NOT NULL").toArrow())
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.execute(f"SELECT {columns} FROM ({ORACLES['op13_centroids']})").fetchall()
    got = [tuple(r) for r in centroids.clusters(table.where("vec_id IS NOT NULL")).collect()]
    assert sorted(got) == sorted(want)


def test_distances_beyond_a_long_are_null(spark):
    table = spark.createDataFrame([(0, [4e15, 0.0]), (1, [-4e15, 0.0]), (2, [0.5, 1e300])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroids.clusters(table, k=1, dims=2, rounds=0).collect()}
    assert sorted(got) == [0, 1] and sorted((r.distance is None for r in got.values())) == [False, True]


@pytest.mark.parametrize("kind", [np.int64, object])
def test_tree_finds_the_nearest_with_ties(kind):
    rng = np.random.default_rng(4)
    for k, dims, step in [(1, 3, 5), (4, 2, 3), (5, 2, 3), (200, 2, 6), (97, 16, 400), (60, 1, 2)]:
        centres = rng.integers(-step, step + 1, (k, dims)).astype(kind)
        x = rng.integers(-step, step + 1, (400, dims)).astype(kind)
        tree = centroids.VantageTree(centres)
        best, least = tree.nearest(x)
        every = np.stack([centroids.squared(x, c) for c in centres], 1)
        assert best.tolist() == [row.index(min(row)) for row in every.tolist()] and least.tolist() == every.min(1).tolist()


def test_tree_leaves_branches_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-10**6, 10**6, (400, 2))
    tree, met = centroids.VantageTree(centres), []
    meet = tree._meet
    tree._meet = lambda x, at, c, *rest: (met.append(len(at)), meet(x, at, c, *rest))[1]
    tree.nearest(rng.integers(-10**6, 10**6, (1000, 2)))
    assert sum(met) < 1000 * 400 / 5
