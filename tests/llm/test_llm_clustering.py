"""Clusters against plain rounds, and the geometric bounds against sampled points."""

import hashlib

import numpy as np
import pytest

from kinmatch.llm import clustering

VEC = "vec_id long, embedding array<float>, label int, cluster string, row int"


def plain(rows, k, rounds, seed, size):
    kept = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 1024).astype(int)) for i, v in rows if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
    draw = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v.tolist()) for i, v in kept)
    centres = [v for _, v in draw[:k]]

    def nearest(v):
        return min((int(((v - np.array(c)) ** 2).sum()), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = (np.sum(members, axis=0) // len(members)).tolist()
    return sorted((i if i is not None else -1, nearest(v)[1], nearest(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 2), (1, 3)])
def test_clusters_are_those_of_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i % 4][1]) for i in range(300, 340)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[1][1])]
    rows += [(400, None), (401, []), (402, [1.0] * 7), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7), (405, [None] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VEC).repartition(3)
    got = clustering.cluster(clustering.whole_vectors(df, 8), k, rounds, 3, 8)
    members, centres = plain(rows, k, rounds, 3, 8)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.members.collect()) == members
    assert got.centres.tolist() == centres
    # Bounds spare some comparisons once centroids settle.
    assert k == 1 or got.scanned[0] == len(members) and min(got.scanned) < len(members)


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 0, "", 0)], VEC)
    assert clustering.clustering(none).count() == 0
    few = spark.createDataFrame([(i, [float(i)] * 64, 0, "", 0) for i in range(3)], VEC)
    rows = clustering.clustering(few).collect()
    assert sorted(r.distance for r in rows) == [0, 0, 0] and {r.inertia for r in rows} == {0}
    large = spark.createDataFrame([(1, [1e9] * 64, 0, "", 0)], VEC)
    with pytest.raises(Exception, match="beyond"):
        clustering.clustering(large).count()


def test_distances_of_large_components():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**27), 2**27, (50, 64))
    c = rng.integers(-(2**27), 2**27, (4, 64))
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert clustering.distances(x, c).tolist() == wanted


def test_bounds_hold_and_are_tighter_than_the_move():
    rng = np.random.default_rng(2)
    tighter = 0
    for _ in range(60):
        old = rng.normal(size=(4, 6)) * 10
        new = old + rng.normal(size=(4, 6)) * rng.uniform(0, 4)
        radius = rng.uniform(0, 12, 4)
        loose = clustering.loosening(old, new, radius)
        full = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(4):
            points = rng.normal(size=(400, 6))
            points = old[i] + points / np.linalg.norm(points, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.2
            for j in {0, 1, 2, 3} - {i}:
                came = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert came.max() <= loose[i] + 1e-9
            most = max(full[j] for j in range(4) if j != i)
            assert loose[i] <= most + 1e-9
            tighter += loose[i] < 0.9 * most
    assert tighter > 60
