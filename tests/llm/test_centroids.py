"""Centroid clustering against whole numbers in plain Python: wide values, ties, repeats, rows left out."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tidewell.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, raw string, kind int"


def plain(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [math.floor(Fraction(v) * scale) for v in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    c = [x for *_, x in sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), ",".join(map(str, x)), x) for i, x in kept)[:k]]

    def assigned():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, row, strict=True)) for row in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assigned()
        own = [[x for (_, x), (a, _) in zip(kept, at, strict=True) if a == n] for n in range(len(c))]
        c = [[sum(v) // len(o) for v in zip(*o, strict=True)] if o else row for o, row in zip(own, c, strict=True)]
    at = assigned()
    long = lambda v: v if v < 2**63 else None
    inertia = [sum(d for a, d in at if a == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return sorted(((i, a, long(d), long(inertia[a]), long(sum(inertia)), sha[a]) for (i, _), (a, d) in zip(kept, at, strict=True)), key=str)


def rows_of(rng, n, dims):
    return [(i, (rng.normal(size=dims) + 3 * (i % 5)).tolist(), "x", 1) for i in range(n)]


@pytest.mark.parametrize("far", [1.0, 1e5, 1e7, 1e9, 1e14, 3e19, 1e300])
def test_as_in_whole_numbers(spark, far):
    rng = np.random.default_rng(int(math.log10(far)) + 4)
    rows = rows_of(rng, 60, 4)
    rows += [(100, [far, -far, far / 3, 0.1], "x", 1), (101, [far * 0.99, -far, 0.0, -0.1], "x", 1), (102, [0.0, -0.0, 5e-324, -5e-324], "x", 1)]
    rows += [rows[3], rows[3], (7, [1.0, 2.0, 3.0, 4.0], "x", 1), (None, [1.5, 2.0, 3.0, 4.0], "x", 1), (None, [1.0, 2.0, 3.0, 4.0], "x", 1)]
    rows += [(200, None, "x", 1), (201, [], "x", 1), (202, [1.0] * 5, "x", 1), (203, [1.0, None, 2.0, 3.0], "x", 1), (204, [1.0, float("nan"), 2.0, 3.0], "x", 1), (205, [1.0, float("inf"), 2.0, 3.0], "x", 1)]
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), k=4, rounds=6, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 4, 6, 4)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2), 0.0], "x", 1) for i in range(12)]  # eight first centroids at two places
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA), k=8, rounds=3, dims=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 8, 3, 2)
    assert len({r["cluster"] for r in got.collect()}) == 2


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0], "x", 1), (2, [2.0, 2.0], "x", 1)]
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA), k=8, rounds=3, dims=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(1, 0), (2, 0)]
    assert centroids.clustered(spark.createDataFrame([], SCHEMA), dims=2).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        centroids.clustered(spark.createDataFrame(rows, SCHEMA), dims=2, scale=1000)


def test_distances_are_exact_on_either_side_of_the_bounds():
    rng = np.random.default_rng(1)
    for top in (10, (1 << 23) - 1, (1 << 25), (1 << 29), 1 << 40, 1 << 62):
        x = rng.integers(-top, top, (50, 8), endpoint=True)
        c = rng.integers(-top, top, (3, 8), endpoint=True)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, far, strict=True)) for far in c] for row in x]
        assert [[int(v) for v in row] for row in centroids.distances(x, c).tolist()] == want
        at = rng.integers(0, 3, 50)
        assert centroids.sums(x, at, 3).tolist() == [[sum(int(v) for v in x[at == i, j]) for j in range(8)] for i in range(3)]


def test_a_wide_row_leaves_the_others_to_the_matrix_product(monkeypatch):
    calls = []
    plain_distances = centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda x, c: calls.append(len(x)) or plain_distances(x, c))
    x = np.array([[1, 2], [1 << 70, 0], [3, 4]], object)
    assert centroids.distances(x, np.array([[0, 0]])).tolist() == [[5], [1 << 140], [25]]
    assert calls == [3, 2]
