"""Centroid clustering of vectors over a vector-approximation file.

Every vector is kept twice: whole, and as a row of cells, one byte a dimension (256 cells between
quantiles of a bounded sample; the outermost two hold what lies beyond the sample). Per round a lookup
table gives, for each dimension, cell and centroid, the least and the greatest share of the distance; their sums
are an interval for each centroid. (Of |x - c|^2 the part |x - m|^2 is left out, m the centroids' middle: all
centroids share it, and what remains is narrow.) Where one interval lies below all others the cells alone
tell the nearest centroid. A round needs only what changed: a vector whose nearest centroid is told by
cells both for the last round's centroids and for this round's, and is the same, adds nothing. The others' whole
vectors are fetched by a join on their row numbers and added or taken away exactly.

Sums are exact integers: tasks add their own vectors, Spark adds the tasks'; the driver sees one row for
each (centroid, dimension). Everything a round reads is written in the shared folder.

Defined cases: vectors with another number of components, or a null or non-finite one, are left out; components
beyond 2^27 in size after scaling count as 2^27, so that a squared distance fits 64 bits; a null id counts as empty in
the seed hash; repeated rows count each; with fewer vectors than centroids there are as many centroids as
vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import discard, materialize, small_side, table

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
BITS = 8
#: Vectors that set the cells' borders. They change what is fetched, never the result.
SAMPLE = 20_000
EXTREME = 1 << 27


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id, vector: the whole vectors of finite components, each scaled and floored."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(EXTREME))), F.lit(float(-EXTREME)))).cast("int")
    rows = df.select(F.col(id_col).alias("vec_id"), v.alias("vector")).where(F.size("vector") == dimensions)
    return rows.where(F.forall("vector", finite)).select("vec_id", F.transform("vector", whole).alias("vector"))


def seed_vectors(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes, k rows at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def cell_borders(vectors: DataFrame, dimensions: int, bits: int, sample: int) -> np.ndarray:
    """(dimensions, 2^bits - 1): where cells begin, from at most ``sample`` vectors."""
    rows = vectors.select("vector", F.xxhash64("vec_id", "vector").alias("h")).orderBy("h").limit(sample).select("vector").toArrow()
    x = matrix(rows.column(0).combine_chunks(), dimensions)
    inner = np.quantile(x, np.linspace(0, 1, (1 << bits) - 1), axis=0, method="inverted_cdf").astype(np.int64)
    inner[-1] += 1  # the last cell lies beyond the sample
    return inner.T.copy()


def cells_of(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for d, edge in enumerate(borders):
        out[:, d] = np.searchsorted(edge, x[:, d], "right")
    return out


def distance_tables(centroids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each (dimension, cell): the centroids' least ones, then their greatest; and what is added at the end."""
    edge = np.full((len(borders), 1), EXTREME)
    low, high = np.hstack([-edge, borders]), np.hstack([borders - 1, edge])
    middle = np.rint(centroids.mean(axis=0)).astype(np.int64)
    slope = -2 * (centroids - middle).T[:, None, :]
    a, b = low[:, :, None] * slope, high[:, :, None] * slope
    fixed = (centroids**2).sum(axis=1) - (middle**2).sum()
    return np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2), np.concatenate([fixed, fixed])


def told_by_cells(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest centroid of each row of cells, -1 where intervals overlap (or touch)."""
    shares, fixed = tables
    k = len(fixed) // 2
    total = np.repeat(fixed[None, :], len(cells), axis=0)
    for d in range(cells.shape[1]):
        total += shares[d][cells[:, d]]
    low, high = total[:, :k], total[:, k:]
    best = high.argmin(axis=1)
    rows = np.arange(len(cells))
    limit = high[rows, best]
    low[rows, best] = np.iinfo(np.int64).max
    return np.where(low.min(axis=1) > limit, best, -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals) and squared distance, exactly."""
    x = x.astype(np.int64)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def cluster_sums(rows: DataFrame, last: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """What ``rows`` add to each centroid's sums and, in the last column, number: under ``now``, less under ``last``."""
    k, dimensions = now.shape

    def add(batches):
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dimensions)
                for centroids, sign in ((now, 1), (last, -1)):
                    if centroids is not None:
                        of = nearest(x, centroids)[0]
                        for j in range(k):
                            mine = x[of == j]
                            total[j, :-1] += sign * mine.sum(axis=0, dtype=np.int64)
                            total[j, -1] += sign * len(mine)
        j, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[j, d])], ["j", "d", "total"])

    parts = rows.select("vector").mapInArrow(add, "j int, d int, total long")
    out = np.zeros((k, dimensions + 1), object)
    for r in parts.groupBy("j", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.j, r.d] = int(r.total)
    return out


def moved_centroids(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floors of the exact means; centroids without vectors stay."""
    rows = [[int(x) // int(s[-1]) for x in s[:-1]] if s[-1] else c.tolist() for c, s in zip(centroids, sums, strict=True)]
    return np.array(rows, np.int64)


def rows_to_fetch(cells: DataFrame, last: np.ndarray, now: np.ndarray, borders: np.ndarray) -> DataFrame:
    """Row numbers whose cluster the cells do not tell, or tell to have changed."""
    before, after, dimensions = distance_tables(last, borders), distance_tables(now, borders), len(borders)

    def pick(batches):
        for batch in batches:
            for part in (batch.slice(a, 8192) for a in range(0, batch.num_rows, 8192)):
                at = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, dimensions)
                a, b = told_by_cells(at, before), told_by_cells(at, after)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array((a < 0) | (a != b)))], ["row"])

    return cells.select("row", "cells").mapInArrow(pick, "row long")


def approximate(vectors: DataFrame, borders: np.ndarray) -> DataFrame:
    """row, cells of each vector."""
    dimensions = len(borders)

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                at = cells_of(matrix(batch.column(1), dimensions), borders)
                ends = np.arange(0, at.size + 1, dimensions, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(at.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["row", "cells"])

    return vectors.select("row", "vector").mapInArrow(cut, "row long, cells binary")


def centroid_clusters(
    df: DataFrame, id_col="vec_id", vector_col="embedding", dimensions=DIMENSIONS, scale=SCALE, k=CENTROIDS, rounds=ROUNDS, seed=SEED, bits=BITS, sample=SAMPLE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    source = integer_vectors(df, id_col, vector_col, dimensions, scale)
    vectors = materialize(source.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "va-vectors")
    centroids = seed_vectors(vectors, k, seed)
    if len(centroids):
        borders = cell_borders(vectors, dimensions, bits, sample)
        cells = materialize(approximate(vectors, borders), "va-cells")
        sums, last = cluster_sums(vectors, None, centroids), centroids
        centroids = moved_centroids(centroids, sums)
        for _ in range(rounds - 1):
            if (centroids == last).all():
                break
            fetch = materialize(rows_to_fetch(cells, last, centroids, borders), "va-fetch")
            sums = sums + cluster_sums(vectors.join(small_side(fetch), "row"), last, centroids)
            last, centroids = centroids, moved_centroids(centroids, sums)
            discard(fetch)
        discard(cells)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                of, distance = nearest(matrix(batch.column(1), dimensions), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "vector").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the sums of distances, by cluster and of all, and the hash of each cluster's centroid."""
    spark = assigned.sparkSession
    rows = materialize(assigned, "va-assigned")
    of = [(j, ",".join(map(str, c.tolist()))) for j, c in enumerate(centroids)]
    names = spark.createDataFrame(of, "cluster int, components string").withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row a centroid
    total = rows.agg(F.sum("distance").alias("inertia"))
    facts = sums.join(names, "cluster").crossJoin(F.broadcast(total))
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*centroid_clusters(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The rounds written out one after another."""
    distance = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), v) - 1 AS c, v AS m FROM kept
  QUALIFY c < {CENTROIDS})""",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST({distance} AS BIGINT) AS d FROM kept, c{n}) GROUP BY r)""")
        if n < ROUNDS:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(u.m, o.m) AS m FROM c{n} o LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m
  FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept JOIN a{n} USING (r)) GROUP BY c, p)
  GROUP BY c) u USING (c))""")
    last = ROUNDS
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{last} USING (r) JOIN c{last} USING (c)"""
    )


OP12_SQL = _sql()
