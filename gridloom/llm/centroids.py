"""Centroid clustering with float32 screening (operator 12).

Vectors turn into integers floor(SCALE * x), held as doubles, which are exact for them. Lloyd's rounds run over a table of
the kept vectors; a round is one job, which returns counts and sums of each cluster and component and nothing else.

Nearest centroids: |c|^2 - 2 x.c orders centroids as the squared distance does. A float32 matrix product gives x.c for
all vectors of a batch and all centroids, and a bound on its rounding gives an interval around each value: with n
components, products of numbers that are themselves rounded add up, in any order, with an error of at most
g * |x| * |c|, g = (n + 2) u / (1 - (n + 2) u), u = 2 ** -24 (and by Cauchy-Schwarz for the sum of absolute products).
Centroids whose intervals reach below the lowest upper end stay; where more than one stays, exact integer distances
decide, the smaller number at equality. Overflown products have no interval, so they are decided exactly too. Integers
are 64-bit where no distance can leave that range (components up to 2 ** 27) and Python's otherwise; sums over a
cluster go in limbs of 40 bits where a plain sum could leave it.

Defined results: vectors that are null, of another number of components, or with a null or non-finite component are left
out; fewer vectors than clusters give as many clusters as vectors; equal rows are vectors of their own; null vec_ids come
last among the starting candidates; a cluster without vectors keeps its centroid; distances and inertias beyond a 64-bit
integer are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

SCALE, LIMB, SMALL, ROWS = 1024, 40, 1 << 27, 4096
UNIT32, UNIT64 = 2.0**-24, 2.0**-53


def integers(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, v) of the vectors that count; v: integers, as doubles."""
    fine = (F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = lambda e: e.cast("double") * SCALE
    whole = F.transform("embedding", lambda e: F.when(F.abs(x(e)) < float(1 << 52), F.floor(x(e)).cast("double")).otherwise(x(e)))
    return vectors.select("vec_id", F.when(fine, whole).alias("v")).where("v IS NOT NULL")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and c, pair by pair: of 64 bits where they fit, else Python integers, as the
    components of c are."""
    if max(np.abs(x).max(initial=0), abs(c).max(initial=0)) <= SMALL:
        d = x.astype(np.int64) - c.astype(np.int64)
        return (d * d).sum(axis=1)
    return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(x, c, strict=True)], object)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for every row of x and of c; infinite where float32 overflows."""
    n = x.shape[1]
    g = (n + 2) * UNIT32 / (1 - (n + 2) * UNIT32)
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        square = (c * c).sum(axis=1)
        length = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
        middle = square[None, :] - 2 * dot
        # the float64 steps around the product: each of them errs by a few units of what it works on
        slack = 2 * g * length * (1 + 1e-6) + 4 * (n + 8) * UNIT64 * (square[None, :] + 2 * length) + n * 2.0**-140
        low, high = middle - slack, middle + slack
    open_ends = ~np.isfinite(middle) | ~np.isfinite(slack)
    return np.where(open_ends, -np.inf, low), np.where(open_ends, np.inf, high)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest row of c for each row of x, the smaller one at equal distance."""
    low, high = intervals(x, c.astype(np.float64))
    stay = low <= high.min(axis=1)[:, None]
    out = stay.argmax(axis=1)
    open_rows = np.flatnonzero(stay.sum(axis=1) > 1)
    if len(open_rows):
        at, j = np.nonzero(stay[open_rows])
        d = exact_distances(x[open_rows[at]], c[j])
        every = np.full((len(open_rows), len(c)), d.max() + 1, d.dtype)
        every[at, j] = d
        out[open_rows] = every.argmin(axis=1)  # the first of equal ones
    return out


def limbs_of(total: int, limbs: int) -> list[int]:
    """The parts of an integer by powers of 2 ** LIMB; all but the last are below that, the last has the sign."""
    out = []
    for _ in range(limbs - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def sums_of(x: np.ndarray, limbs: int) -> list[int]:
    if limbs == 1:
        return x.astype(np.int64).sum(axis=0).tolist()
    return [sum(map(int, column)) for column in x.T]


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, limbs: int) -> tuple[dict, dict]:
    """Counts of the clusters and sums of their vectors' components, by cluster and by cluster and component. Centroids are
    Python integers, as means of large ones aren't doubles."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c, count, total = shared.value, {}, {}
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else np.empty((0, c.shape[1]))
            for a in range(0, len(x), ROWS):
                part = x[a : a + ROWS]
                mine = nearest(part, c)
                for j in np.unique(mine).tolist():
                    own = part[mine == j]
                    count[j] = count.get(j, 0) + len(own)
                    total[j] = [p + q for p, q in zip(total.get(j, [0] * c.shape[1]), sums_of(own, limbs), strict=True)]
        rows = [(j, -1, 0, n) for j, n in count.items()]
        rows += [(j, i, k, part) for j, t in total.items() for i, s in enumerate(t) for k, part in enumerate(limbs_of(s, limbs))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["j", "i", "limb", "part"])

    got = vectors.select("v").mapInArrow(run, "j long, i long, limb long, part long").groupBy("j", "i", "limb").agg(F.sum("part").alias("part"))
    counts, sums = {}, {}
    for r in got.collect():  # a row for each cluster, component and limb
        if r["i"] < 0:
            counts[r["j"]] = r["part"]
        else:
            sums[r["j"], r["i"]] = sums.get((r["j"], r["i"]), 0) + (r["part"] << (LIMB * r["limb"]))
    return counts, sums


def centroids_of(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after some rounds; rounds that could change nothing more aren't run."""
    top = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"), F.count("*").alias("n")).first()
    bits = int(top["top"]).bit_length() + int(top["n"]).bit_length()
    limbs = 1 if bits <= 62 else bits // LIMB + 1
    now = start
    for _ in range(rounds):
        counts, sums = cluster_sums(vectors, now, limbs)
        new = now.copy()
        for j, n in counts.items():
            new[j] = [sums[j, i] // n for i in range(now.shape[1])]
        if np.array_equal(new, now):
            break
        now = new
    return now


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance); distances beyond 64 bits are null."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            mine, far = [], []
            for a in range(0, len(x), ROWS):
                j = nearest(x[a : a + ROWS], c)
                mine += j.tolist()
                far += exact_distances(x[a : a + ROWS], c[j]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine, pa.int32()), pa.array([d if d < 1 << 63 else None for d in far], pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def summed(column: str) -> Column:
    """The sum of non-null longs, null beyond 64 bits."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count("*")) & (total <= F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")), total.cast("long"))


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, salt: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector (vec_id, embedding) that
    counts. Starts are the vectors whose sha256 of `salt:vec_id` is smallest."""
    spark = vectors.sparkSession
    held = materialise(integers(vectors, size))
    named = held.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    start = np.array([[int(x) for x in r["v"]] for r in named.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()], object).reshape(-1, size)
    if not len(start):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    final = centroids_of(held, start, rounds)
    found = materialise(assigned(held, final))
    per = found.groupBy("cluster").agg(summed("distance").alias("cluster_inertia"))
    every = found.agg(summed("distance").alias("inertia")).first()["inertia"]
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(final)]
    told = per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    out = found.join(F.broadcast(told), "cluster")  # a row a cluster
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")


def oracle_sql(clusters: int = 8, rounds: int = 10, size: int = 64, salt: int = 3) -> str:
    """The rounds as one chain of tables, over vectors whose numbers fit 64 bits."""
    fine = f"len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    d2 = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings WHERE {fine}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS j, v AS c FROM k QUALIFY j < {clusters})"""
    near = lambda t: f"SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, CAST({d2} AS BIGINT) AS d FROM k, c{t}) GROUP BY r"
    for t in range(rounds):
        out += f""",
a{t} AS MATERIALIZED ({near(t)}),
s{t} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({size})) AS i FROM k JOIN a{t} USING (r)) GROUP BY j, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY j) m USING (j))"""
    return out + f""",
f AS MATERIALIZED ({near(rounds)})
SELECT vec_id, f.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN k USING (r) JOIN c{rounds} ON c{rounds}.j = f.j
"""
