"""Approximate nearest neighbours over balanced posting lists (operator 2).

A bounded sample fits centroids by repeated balanced halving. Every vector goes to its nearest list and, near a border, to
further ones. Lists that lie together form shards, and a shard that holds more rows than planned is split by a hash, so hot
vectors never meet in one task. A query walks an in-memory graph of the centroids and takes every list whose distance is
within a ratio of the nearest; the ratio is calibrated on the sample. Each shard returns a query's best rows only.

Nearness is the inner product. Vectors get one more coordinate that makes all of them equally long, after which the largest
inner product is the smallest distance.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, prepare

#: Vectors the index is fitted on at most, and bytes of them in double precision at most.
SAMPLE, SAMPLE_BYTES = 65_536, 128 << 20
#: Vectors of a list; lists at most; copies of a vector; border for copies; rows of a shard.
LIST, LISTS, COPIES, BORDER, SHARD = 64, 8192, 2, 1.01, 16_384
#: Share of the sample's true neighbours that the calibrated ratio must reach.
TARGET = 0.95


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a vector that is not null, not zero and holds no null, NaN or infinity."""
    v = df[vector]
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(v.isNotNull() & good & F.exists(v, lambda x: x != 0))


@dataclass
class Index:
    centroids: np.ndarray  # in list order; neighbours in the order lie together
    graph: list[np.ndarray]
    longest: float
    per_shard: int  # lists of a shard
    ratio: float = 1.5

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of lifted rows to all centroids."""
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(d, 0))

    def copies(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, lists): the nearest list of each row, and further ones within the border."""
        d = self.distances(self.lifted(x))
        take = min(COPIES, d.shape[1])
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
        dist = np.take_along_axis(d, near, axis=1)
        rows, cols = np.nonzero(dist <= dist.min(axis=1, keepdims=True) * BORDER + 1e-9)
        return rows, near[rows, cols]

    def probe(self, q: np.ndarray, effort: int = 24) -> np.ndarray:
        """Lists within the ratio of the nearest, found by a best-first walk over the graph of centroids."""
        k = len(self.centroids)
        starts = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        dist = {int(i): float(d) for i, d in zip(starts, np.linalg.norm(self.centroids[starts] - q, axis=1), strict=True)}
        heap = [(d, i) for i, d in dist.items()]
        heapq.heapify(heap)
        best, done = min(dist.values()), 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > best * self.ratio and done >= effort:
                break
            done += 1
            new = [j for j in self.graph[i].tolist() if j not in dist]
            if new:
                for j, e in zip(new, np.linalg.norm(self.centroids[new] - q, axis=1).tolist(), strict=True):
                    dist[j] = e
                    best = min(best, e)
                    heapq.heappush(heap, (e, j))
        return np.array(sorted(i for i, d in dist.items() if d <= best * self.ratio + 1e-9), dtype=np.int32)


def halves(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of ``parts`` (a power of two) equally large groups, by two-means cut at the median."""
    if parts == 1:
        return [x.mean(axis=0)]
    a, b = x[rng.integers(0, len(x), 2)]
    for _ in range(6):
        side = ((x - a) ** 2).sum(axis=1) - ((x - b) ** 2).sum(axis=1)
        order = np.argsort(side, kind="stable")
        half = len(x) // 2
        a, b = x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)
    return halves(x[order[:half]], parts // 2, rng) + halves(x[order[half:]], parts // 2, rng)


def fit(sample: np.ndarray, n: int, longest: float, k: int, seed: int = 5) -> Index:
    """Index for ``n`` vectors from a sample of them, its ratio calibrated for the ``k`` nearest."""
    rng = np.random.default_rng(seed)
    lists = 1 << max(0, min(math.ceil(math.log2(max(1, n / LIST))), int(math.log2(LISTS)), int(math.log2(max(1, len(sample) // 8)))))
    index = Index(np.zeros((1, sample.shape[1] + 1)), [np.zeros(0, int)], longest, lists)
    x = index.lifted(sample)
    index.centroids = np.array(halves(x, lists, rng)) if len(x) else index.centroids
    c = index.centroids
    near = min(lists - 1, 24)
    if near:
        links = []
        for at in range(0, lists, 256):  # in blocks: all distances at once would be lists squared
            closest = np.argpartition(index.distances(c[at : at + 256]), near, axis=1)[:, : near + 1]
            links += [set(of) | {(at + i + 1) % lists, (at + i - 1) % lists} for i, of in enumerate(closest.tolist())]
        for i, of in enumerate(links):
            for j in list(of):
                links[j].add(i)  # both ways
        index.graph = [np.array(sorted(of - {i}), dtype=int) for i, of in enumerate(links)]
    index.per_shard = max(1, round(lists * SHARD / max(1, n * 1.6)))
    # calibration: how far, relative to the nearest list, the lists of true neighbours lie
    queries = rng.permutation(len(sample))[: min(256, len(sample))]
    found = [index.copies(sample[at : at + 1024]) for at in range(0, len(sample), 1024)]
    rows = np.concatenate([r + 1024 * i for i, (r, _) in enumerate(found)]) if found else np.zeros(0, np.int64)
    of = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    first = np.searchsorted(rows, np.arange(len(sample)))
    owner = np.full((len(sample), COPIES), -1)
    owner[rows, np.arange(len(rows)) - first[rows]] = of
    needed = []
    for q in queries.tolist():
        s = sample @ sample[q]
        s[q] = -np.inf
        top = np.argpartition(-s, min(k, len(s) - 1))[:k] if len(s) > 1 else np.zeros(0, int)
        lifted = np.append(sample[q], 0.0)
        d = np.linalg.norm(c - lifted, axis=1)
        to = np.where(owner[top] >= 0, d[owner[top]], np.inf).min(axis=1)
        needed.append(to / max(d.min(), 1e-12))
    index.ratio = float(np.quantile(np.concatenate(needed), TARGET)) if needed else 1.0
    index.ratio = max(index.ratio, 1.0) + 1e-6
    return index


def best_of(q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: int, k: int, spans: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows for one query, ties to smaller ids, each id once.

    ``spans`` are the stretches of rows to look at, all by default; rows are scored where they lie, without copies."""
    spans = spans if spans is not None else [(0, len(ids))]
    s = np.concatenate([vectors[a:b] @ q for a, b in spans]) if spans else np.zeros(0)
    at = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, dtype=np.int64)
    s[ids[at] == own] = -np.inf
    if len(s) > 2 * k:
        cut = np.partition(s, len(s) - 2 * k)[len(s) - 2 * k]
        pick = np.flatnonzero(s >= cut - 1e-9 * max(1.0, abs(cut))) if np.isfinite(cut) else np.flatnonzero(np.isfinite(s))
    else:
        pick = np.flatnonzero(np.isfinite(s))
    pick = at[pick]
    exact = (vectors[pick] * q).sum(axis=1)  # row by row, so that equal vectors score equally
    order = np.lexsort((ids[pick], -exact))
    found, first = np.unique(ids[pick][order], return_index=True)
    keep = np.sort(first)[:k]
    return ids[pick][order][keep], exact[order][keep]


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``df`` for every row of ``queries``, by inner product.

    Rows whose id is the query's own do not count. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids, nor vectors of another length than the most common one (the shorter, of two as common). Scores are
    in double precision on the original vectors; ties go to the smaller id; repeated ids count once, by the best score. All
    candidates are returned where there are fewer than ``k``. Empty in, empty out. Other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)

    def rows_of(frame: DataFrame) -> DataFrame:
        return usable(frame, vector).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))

    # vectors keep their own width while they move; every score is computed in double precision
    kind = "array<float>" if all("array<float>" == f.schema[vector].dataType.simpleString() for f in (df, queries)) else "array<double>"
    base = rows_of(df)
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))")).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n, longest = sizes[0]["d"], sizes[0]["n"], math.sqrt(sizes[0]["m"])
    base, asked = base.where(F.size("v") == dim), rows_of(queries).where(F.size("v") == dim)

    def vectors_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)

    some = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    part = base.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, some / n))).orderBy(F.xxhash64("id"), "id").limit(some)
    index = fit(vectors_of(part.select("v").toArrow().column(0).combine_chunks()), n, longest, k)
    shared = spark.sparkContext.broadcast(index)  # LISTS centroids at most

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lists = shared.value.copies(vectors_of(batch.column(1)))
        got = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array((lists // shared.value.per_shard).astype(np.int32)), pa.array(lists.astype(np.int32)), *got.columns], names=["shard", "list", "id", "v"])

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors_of(batch.column(1))
        shards, which, rows = [], [], []
        for i, q in enumerate(np.column_stack((x, np.zeros(len(x))))):
            lists = shared.value.probe(q)
            of = lists // shared.value.per_shard
            for s in np.unique(of):
                shards.append(int(s))
                which.append(lists[of == s].tolist())
                rows.append(i)
        got = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(which, pa.list_(pa.int32())), *got.columns], names=["shard", "lists", "id", "v"])

    posted = materialize(map_batches(base, place, f"shard int, list int, id long, v {kind}"))
    # shards that came out larger than planned are split by a hash of the id; at most LISTS rows here
    parts = posted.groupBy("shard").agg(F.greatest(F.lit(1), F.round(F.count("*") / SHARD).cast("int")).alias("parts"))
    parts = F.broadcast(spark.createDataFrame(parts.collect(), parts.schema))
    vectors = posted.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    walked = map_batches(asked, walk, f"shard int, lists array<int>, id long, v {kind}")
    to = walked.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by("list")
            number, ids = right.column("list").to_numpy(), right.column("id").to_numpy()
            vs = vectors_of(right.column("v").combine_chunks())
            qs = vectors_of(left.column("v").combine_chunks())
            for own, lists, q in zip(left.column("id").to_pylist(), left.column("lists").to_pylist(), qs, strict=True):
                a, b = np.searchsorted(number, lists, side="left"), np.searchsorted(number, lists, side="right")
                found, score = best_of(q, ids, vs, own, k, [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y > x])
                out[0] += [own] * len(found)
                out[1] += found.tolist()
                out[2] += score.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    got = to.groupBy("shard", "part").cogroup(vectors.groupBy("shard", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    once = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, df: DataFrame, asked: list[int], id_col: str = "vec_id", vector: str = "embedding", k: int = 20) -> float:
    """Share of the true ``k`` nearest that ``found`` has, for a few query ids; compares each with all rows (for tests)."""
    rows = usable(df, vector).select(id_col, vector).toPandas()
    ids, v = rows[id_col].to_numpy(), np.array(rows[vector].tolist(), dtype=np.float64)
    got = {q: set() for q in asked}
    for r in found.where(F.col("query_id").isin(asked)).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in asked:
        true, _ = best_of(v[ids == q][0], ids, v.copy(), q, k)
        hits += len(got[q] & set(true.tolist()))
        total += len(true)
    return hits / total
