"""Clustering over cells against plain rounds on whole vectors."""

import hashlib

import numpy as np
import pytest

from quantloom.llm import clusters

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, dimensions, k=8, rounds=10, seed=3):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, d, c in found], key=repr)


def run(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(5)
    return sorted(map(tuple, clusters.with_inertia(*clusters.centroid_clusters(df, **options)).collect()), key=repr)


@pytest.mark.parametrize(("bits", "sample"), [(8, 20_000), (3, 50), (1, 5)])
def test_against_plain_rounds(spark, bits, sample):
    """Whatever the cells, the result is the same."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(5, 6))
    rows = [(int(i), (middles[i % 5] + 0.4 * rng.normal(size=6)).tolist()) for i in range(700)]
    assert run(spark, rows, dimensions=6, bits=bits, sample=sample) == plain(rows, 6)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [-0.1, 3.0]), (4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 2.0, 3.0])]
    rows += [(i, [0.0, 0.0]) for i in range(20, 60)] + [(i, [0.5, -0.5]) for i in range(60, 80)]
    assert run(spark, rows, dimensions=2) == plain(rows, 2)
    assert run(spark, rows[:3], dimensions=2) == plain(rows[:3], 2)  # fewer vectors than centroids
    clash = [(*r, 7, "x", 1.0) for r in rows]
    assert run(spark, clash, SCHEMA + ", cluster int, vector string, row double", dimensions=2) == plain(rows, 2)
    assert run(spark, [], dimensions=2) == []


def test_extremes_are_clamped(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])]
    found = run(spark, rows, dimensions=2, k=1, rounds=0 + 1)
    assert max(r[2] for r in found) <= 2 * (1 << 28) ** 2 and len(found) == 3


def test_cells_tell_only_what_is_certain():
    rng = np.random.default_rng(8)
    x = rng.integers(-600, 600, (3000, 16))
    centroids = rng.integers(-300, 300, (8, 16))
    borders = np.quantile(x[:500], np.linspace(0, 1, 255), axis=0, method="inverted_cdf").astype(np.int64).T
    borders[:, -1] += 1
    told = clusters.told_by_cells(clusters.cells_of(x, borders), clusters.distance_tables(centroids, borders))
    exact = clusters.nearest(x, centroids)[0]
    assert (told[told >= 0] == exact[told >= 0]).all() and (told >= 0).mean() > 0.8


def test_query_fetches_a_part_and_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    found = sorted(map(tuple, clusters.op12_centroids(spark, sf).collect()))
    embeddings = duckdb.read_parquet(f"{sf}/embeddings.parquet")  # noqa: F841
    assert found == sorted(duckdb.sql(clusters.OP12_SQL).fetchall())
