"""Centroid clustering with bounds that drift geometry tightens.

Each vector carries an upper bound on the distance to its own centroid and a lower bound on that to every other. After centroids have
moved, the members of cluster i lie in a sphere around its old centroid, its radius the greatest upper bound. How much
nearer centroid j can have come to any point of that sphere is a problem in the plane of i's centroid and j's old and new places:
at each place c on j's way, a point x of the sphere sees j come by at most cos(angle) of the step, the angle between the way and x - c being at least
that of the sphere's centre less the sphere's half-aperture. Summed over pieces of the way, each with its worst angle, this is a
bound at or below j's full drift (below zero where j leaves); the lower bounds of i's members loosen by its greatest value over j only. A vector whose upper bound stays below the lower
one, or below half the way to the next centroid, keeps its cluster unseen; any other first has its own
distance computed and, if still ambiguous, is scanned against all centroids in exact integers. Bounds carry a slack above their
rounding error, so ties are always scanned, and go to the smaller number.

A round reads the vectors in parallel and writes their new state; the centroids (k of them) and k x k bounds travel with the tasks. Centroids move by
the sums of vectors that changed cluster: one partial row a task and cluster. The driver holds those sums alone, k rows.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out. A component's integer is held within
+-2^27, so that distances fit 64 bits (|x| up to 2^21 is exact). Repeated rows are vectors of their own; in the choice of first centroids, rows of equal
hash go by their components. A null vec_id hashes as an empty one. Fewer vectors than k: that many centroids. Inertias above 2^63 - 1 stay there. No vectors: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
HELD = 2**27
#: Relative slack of bounds, far above the rounding error of square roots and sums in doubles.
SLACK = 1e-9
#: Pieces that a centroid's way is cut into.
PIECES = 16
STATE = "vec_id long, v array<long>, cluster int, before int, upper double, lower double, distance long, scans int"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, v: integer components of the vectors that count."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    kept = vectors.filter((F.size("embedding") == dimensions) & F.coalesce(sound, F.lit(False)))
    held = F.transform(x, lambda e: F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), F.floor(F.greatest(F.lit(-4.0 * HELD), F.least(F.lit(4.0 * HELD), e * SCALE))).cast("double"))).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("v"))


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest hash, in its order: a top-k, k rows reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: at least as much as the distance to centroid j can have shrunk for any point within radius[i] of old[i]."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    way = b - a
    drift = np.sqrt((way * way).sum(1))
    rel = a[:, None, :] - a[None, :, :]
    along = np.divide((rel * way[None]).sum(2), drift[None], out=np.zeros((len(a), len(a))), where=drift[None] > 0)
    across = np.sqrt(np.maximum((rel * rel).sum(2) - along * along, 0.0))
    total = np.zeros_like(along)
    for p in range(PIECES):
        near, far = drift * p / PIECES, drift * (p + 1) / PIECES
        angle = np.arctan2(across, along - near[None])  # grows along the way
        foot = np.clip(along, near[None], far[None])
        least = np.hypot(across, along - foot)
        outside = least > radius[:, None]
        ratio = np.divide(radius[:, None], least, out=np.zeros_like(least), where=outside)
        total += (far - near)[None] * np.cos(np.where(outside, np.maximum(angle - np.arcsin(ratio), 0.0), 0.0))
    return np.minimum(total, drift[None]) + 100 * SLACK * (drift[None] + radius[:, None] + np.abs(rel).sum(2) + 1.0)


def _square(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, apart: np.ndarray):
    """Nearest centroids -> cluster, upper, lower, and which vectors were scanned. cluster -1: not yet assigned. apart: half the way to each centroid's nearest other."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    known = np.where(cluster >= 0, cluster, 0)
    limit = np.maximum(lower, apart[known])
    ambiguous = (cluster < 0) | ~(upper * (1 + SLACK) + SLACK < limit * (1 - SLACK))
    seen = np.flatnonzero(ambiguous & (cluster >= 0))
    if len(seen):
        upper[seen] = np.sqrt(_square(v[seen], centroids[cluster[seen]]).astype(np.float64))
        ambiguous[seen] = ~(upper[seen] * (1 + SLACK) + SLACK < limit[seen] * (1 - SLACK))
    at = np.flatnonzero(ambiguous)
    if len(at):
        squares = np.stack([_square(v[at], c) for c in centroids], 1)
        best = squares.argmin(1)  # the first of equals
        rows = np.arange(len(at))
        cluster[at], upper[at] = best, np.sqrt(squares[rows, best].astype(np.float64))
        squares[rows, best] = np.iinfo(np.int64).max
        lower[at] = np.sqrt(squares.min(1).astype(np.float64)) if len(centroids) > 1 else math.inf
    return cluster, upper, lower, ambiguous


def _apart(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to its nearest other."""
    out = np.full(len(centroids), math.inf)
    for i, c in enumerate(centroids):
        d = _square(centroids, c).astype(np.float64)
        d[i] = math.inf
        out[i] = math.sqrt(d.min()) / 2
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, loose: np.ndarray, exact: bool) -> DataFrame:
    """The state after one assignment. drift, loose: how far each centroid has moved, how much its members' lower bounds loosen."""
    apart = _apart(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, flat = batch.num_rows, batch.column("v")
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, centroids.shape[1])
            before = _column(batch, "cluster").astype(np.int64)
            known = np.where(before >= 0, before, 0)
            upper, lower = _column(batch, "upper") + drift[known], _column(batch, "lower") - loose[known]
            cluster, upper, lower, scanned = assign(v, centroids, before, upper, lower, apart)
            distance = _square(v, centroids[cluster]) if exact else np.zeros(n, np.int64)
            yield pa.record_batch([batch.column("vec_id"), flat, pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), pa.array((_column(batch, "scans") + scanned).astype(np.int32))], [c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(each, STATE)


def _moved(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What vectors that changed cluster add to each cluster's count and sums (exact Python integers)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, object), np.zeros((k, dimensions), object)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimensions)
            for sign, to in ((1, _column(batch, "cluster")), (-1, _column(batch, "before"))):
                for c in np.unique(to[to >= 0]):
                    own = v[to == c]  # a batch's sum fits 64 bits
                    counts[c] += sign * len(own)
                    sums[c] += sign * own.sum(0).astype(object)
        rows = [(c, str(counts[c]), ",".join(map(str, sums[c]))) for c in range(k) if counts[c] or any(sums[c])]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))], ["c", "n", "sums"])

    parts = state.filter("cluster <> before").select("v", "cluster", "before").mapInArrow(each, "c int, n string, sums string")
    parts = parts.select("c", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode(F.split("sums", ",")).alias("i", "s"))
    found = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    counts, sums = np.zeros(k, object), np.zeros((k, dimensions), object)
    for r in found:
        counts[r["c"]], sums[r["c"], r["i"]] = int(r["n"]), int(r["s"])
    return counts, sums


def clustered(kept: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """kept (vec_id, v) -> the state after rounds of assignment and move and a last assignment, with exact distances; the centroids."""
    kept = materialize(kept, "vectors")
    centroids = first_centroids(kept, k, seed)
    none = [F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(math.inf).alias("upper"), F.lit(-math.inf).alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("scans")]
    state = kept.select("vec_id", "v", *none)
    if not len(centroids):
        return state, centroids
    k, dimensions = centroids.shape
    counts, sums = np.zeros(k, object), np.zeros((k, dimensions), object)
    drift = loose = np.zeros(k)
    for _ in range(rounds):
        state = materialize(_round(state, centroids, drift, loose, False), "clusters")
        more, added = _moved(state, k, dimensions)
        counts, sums = counts + more, sums + added
        radius = np.zeros(k)
        for r in state.groupBy("cluster").agg(F.max("upper").alias("r")).collect():
            radius[r["cluster"]] = r["r"] * (1 + SLACK)
        moved = np.array([[int(s) // int(n) for s in row] if n else list(map(int, old)) for row, n, old in zip(sums, counts, centroids, strict=True)], np.int64)
        by_pair = loosening(centroids, moved, radius)
        np.fill_diagonal(by_pair, -math.inf)
        loose = by_pair.max(1) if k > 1 else np.zeros(1)
        drift = np.sqrt(_square(moved, centroids).astype(np.float64)) * (1 + SLACK)
        centroids = moved
    return materialize(_round(state, centroids, drift, loose, True), "clusters"), centroids


def report(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centroids = clustered(integers(vectors), k, rounds, seed)
    own = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own")).collect()  # k rows
    every = min(sum(int(r["_own"]) for r in own), 2**63 - 1)
    rows = [(int(r["cluster"]), min(int(r["_own"]), 2**63 - 1), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in own]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")


def _report_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Lloyd's rounds unrolled, every distance computed."""
    nearest = "(select x.r, x.vec_id, x.v, arg_min(c.c, struct_pack(d := dist(x.v, c.v), c := c.c)) as cluster, min(dist(x.v, c.v)) as distance from kept x, {cents} c group by x.r, x.vec_id, x.v)".replace(
        "dist(x.v, c.v)", "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    )
    steps = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS})""",
        f"cents0 as materialized (select cast(row_number() over (order by h, v) - 1 as int) as c, v from (select sha256(concat('{SEED}:', vec_id)) as h, v from kept order by h, v limit {k}))",
    ]
    for t in range(rounds):
        steps += [
            f"near{t} as materialized {nearest.format(cents=f'cents{t}')}",
            f"parts{t} as (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from near{t})",
            f"""moved{t} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from (select cluster, i, sum(x) as s, count(*) as n from parts{t} group by cluster, i) group by cluster)""",
            f"cents{t + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from cents{t} c left join moved{t} m on m.cluster = c.c)",
        ]
    steps.append(f"done as materialized {nearest.format(cents=f'cents{rounds}')}")
    return f"""with {", ".join(steps)}
select d.vec_id, cast(d.cluster as int) as cluster, cast(d.distance as bigint) as distance, cast(sum(d.distance) over (partition by d.cluster) as bigint) as cluster_inertia,
       cast(sum(d.distance) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from done d join cents{rounds} c on c.c = d.cluster
"""


REPORT_SQL = _report_sql()
