"""SimHash near-duplicates through vantage-point trees (operator 5).

Distinct fingerprints are the points of a Hamming space. A top tree of vantage points, fitted on a sample, deals every
fingerprint to the one shard that is its home; the triangle bound tells which other shards can hold points within the radius,
and only a fingerprint whose ball crosses a boundary visits the other side (from the inner side alone, as one visit is enough
for a pair). A shard then searches its points by a vantage-point tree of its own, exactly. It returns a spanning forest of the
links it found, never all pairs, and the forests of all shards are joined into components.

Every level of the top tree costs visits, the more the less the fingerprints cluster, so there are no more shards than keep
the cluster busy and a shard within SHARD fingerprints (2 MB): its size does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_names, map_batches, materialize, prepare
from .components import connected_components

SEED = 42
WORDS = 3
RADIUS = 2
#: Fingerprints that a shard is planned for at least and at most, and shards for each shuffle partition between these.
LEAST, SHARD, SPREAD = 8192, 1 << 18, 2
#: Fingerprints that the top tree is fitted on: so many at least, and so many for each shard.
SAMPLE, PER_SHARD = 65_536, 64
#: Rows of one fingerprint from which it is joined by broadcast; there are never more than 10,000 of those.
HOT = 100_000
#: Ids of documents to drop that may be broadcast: 16 MB at most.
BROADCAST_IDS = 1_000_000
#: Points below which a shard's tree compares directly.
LEAF = 192


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the bits of the XXH64 of every shingle, repeats included; 0 without words, a tie gives 0."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); a null text counts as empty and has fingerprint zero."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def distance(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one)


def choose(points: np.ndarray, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that splits ``points`` near the middle with fewest points near the border."""
    best = None
    some = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    for vp in points[rng.integers(0, len(points), tries)]:
        d = np.bincount(distance(some, vp), minlength=65)
        inner = np.cumsum(d)
        near = np.concatenate(([0, 0], inner))[:65]  # inner[r - 2]
        wide = np.concatenate((inner, [inner[-1]] * 2))[2:67]
        # what both sides together would have to look at, in pairs
        cost = inner * inner + (len(some) - near) * (len(some) - inner) + (wide - inner) * inner
        cost = np.where((inner > 0) & (inner < len(some)), cost, np.iinfo(np.int64).max)
        r = int(np.argmin(cost))
        if (inner[r] < len(some)) and inner[r] > 0 and (best is None or cost[r] < best[0]):
            best = (cost[r], vp, r)
    return best and best[1:]


class Tree:
    """The top tree as flat arrays: vantage point and radius of inner nodes, shard number (negative: ~shard) of leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaves, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        found = choose(points, rng) if leaves > 1 and len(points) > 8 else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        vp, r = found
        inner = distance(points, vp) <= r
        share = min(leaves - 1, max(1, round(leaves * inner.mean())))
        a = self._grow(points[inner], share, rng)
        b = self._grow(points[~inner], leaves - share, rng)
        self.nodes.append((vp, r, a, b))
        return len(self.nodes) - 1

    def route(self, fp: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indexes at home there, indexes that visit it) for every shard that is touched."""
        out, todo, none = [], [(self.root, np.arange(len(fp)), np.zeros(0, np.int64))], np.zeros(0, np.int64)
        while todo:
            node, home, visit = todo.pop()
            if not len(home) and not len(visit):
                continue
            if node < 0:
                out.append((-node - 1, home, visit))
                continue
            vp, r, a, b = self.nodes[node]
            dh, dv = distance(fp[home], vp).astype(np.int64), distance(fp[visit], vp).astype(np.int64) if len(visit) else none
            todo.append((a, home[dh <= r], visit[dv - radius <= r]))
            crossing = home[(dh <= r) & (dh + radius > r)]
            todo.append((b, home[dh > r], np.concatenate((visit[dv + radius > r], crossing))))
        return out


class Forest:
    """A spanning forest over numbered points; links come in blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            self.settle()

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up


def links_within(home: np.ndarray, visit: np.ndarray, radius: int, seed: int = 11) -> np.ndarray:
    """Roots of the points home + visit, linked where a point of ``home`` is within ``radius`` of another point of either."""
    fp, n, rng = np.concatenate((home, visit)), len(home), np.random.default_rng(seed)
    forest, held = Forest(len(fp)), []

    def flush() -> None:
        if held:
            forest.link(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held.clear()

    todo = [(np.arange(n), np.arange(n, len(fp)))]
    size = 0
    while todo:
        # points: pairs among them count; others: pairs of one of them with one of the points count
        points, others = todo.pop()
        if not len(points):
            continue
        found = choose(fp[points], rng) if len(points) > LEAF else None
        if found is None:
            for at in range(0, len(points), LEAF):
                block, rest = points[at : at + LEAF], np.concatenate((points[at:], others))
                for start in range(0, len(rest), 16384):
                    part = rest[start : start + 16384]
                    i, j = np.nonzero(np.bitwise_count(fp[block][:, None] ^ fp[part][None, :]) <= radius)
                    a, b = block[i], part[j]
                    keep = forest.root[a] != forest.root[b]
                    if keep.any():
                        held.append((a[keep], b[keep]))
                        size += int(keep.sum())
                        if size > 200_000:
                            flush()
                            size = 0
            continue
        vp, r = found
        dp, do = distance(fp[points], vp).astype(np.int64), distance(fp[others], vp).astype(np.int64)
        crossing = points[(dp <= r) & (dp + radius > r)]
        todo.append((points[dp <= r], others[do - radius <= r]))
        todo.append((points[dp > r], np.concatenate((others[do + radius > r], crossing))))
    flush()
    return forest.root


def shards_for(n: int, partitions: int, least: int = LEAST, shard: int = SHARD) -> int:
    """Shards for ``n`` fingerprints: SPREAD for each partition, but none smaller or larger than planned."""
    return max(1, math.ceil(n / shard), min(SPREAD * partitions, math.ceil(n / least)))


def near_links(classes: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp``, whose components are those of all pairs within ``radius``.

    The driver fits the top tree on 65,536 fingerprints or, beyond a thousand shards, on 64 for each shard: one in 4096."""
    spark = classes.sparkSession
    prepare(spark)
    n = classes.count()
    shards = math.ceil(n / shard) if shard else shards_for(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = max(SAMPLE, PER_SHARD * shards)
    # a threshold first, so that only about as many as are needed are sorted
    share = F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.2 * some / max(1, n)))
    picked = classes.where(share).orderBy(F.xxhash64("fp")).limit(some).select("fp").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    tree = Tree(np.sort(picked), min(shards, max(1, len(picked) // 16)))
    top = spark.sparkContext.broadcast(tree)  # a node for each shard

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = top.value.route(fp.view(np.uint64), radius)
        at = np.concatenate([np.concatenate((h, v)) for _, h, v in parts])
        number = np.repeat([s for s, _, _ in parts], [len(h) + len(v) for _, h, v in parts])
        home = np.concatenate([np.repeat([True, False], [len(h), len(v)]) for _, h, v in parts])
        return pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(fp[at]), pa.array(home)], names=["shard", "fp", "home"])

    def search(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(list(groups))
        fp, home = data.column("fp").to_numpy().view(np.uint64), data.column("home").to_numpy().astype(bool)
        points = np.concatenate((fp[home], fp[~home]))
        root = links_within(fp[home], fp[~home], radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(points[moved].view(np.int64)), pa.array(points[root[moved]].view(np.int64))], names=["u", "v"])

    dealt = map_batches(classes.select("fp"), deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches(list(search(iter(t.to_batches())))) if t.num_rows else t, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id among the documents that links reach, itself included.

    A null text counts as empty (fingerprint zero, linked like any other). Null ids keep their rows; a component of null
    ids alone has a null component_id. Repeated rows are kept. Only doc_id and text are read. Empty in, empty out.
    """
    prints, by_print, hot = components_of(docs, words, seed, radius, shard)
    return with_components(prints, by_print, hot).select("doc_id", "fp", "component_id")


def with_components(prints: DataFrame, by_print: DataFrame, hot: int) -> DataFrame:
    """``prints`` with root and component_id. Fingerprints of at least ``hot`` rows are few, and are broadcast."""
    if not hot:
        return prints.join(by_print.drop("n"), "fp")
    many = F.broadcast(by_print.where(F.col("n") >= hot).drop("n"))
    rest = prints.join(many.select("fp"), "fp", "left_anti").join(by_print.where(F.col("n") < hot).drop("n"), "fp")
    return rest.unionByName(prints.join(many, "fp"))


def components_of(docs: DataFrame, words: int, seed: int, radius: int, shard: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, fp) of every row; (fp, root, component_id, n) of every distinct fingerprint, where root tells components
    apart; and the number of rows from which a fingerprint counts as hot, 0 if none does."""
    prints = materialize(fingerprints(docs, words, seed))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    total, most = classes.agg(F.sum("n"), F.max("n")).first()
    hot = max(HOT, (total or 0) // 10_000)
    parts = connected_components(near_links(classes, radius, shard))
    of = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, of.select("fp", "root", "n").join(ids, "root").select("fp", "root", "component_id", "n"), hot if (most or 0) >= hot else 0


def hex_of(fp: Column) -> Column:
    """The 64 bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """The documents of ``docs``, exactly one of each component: one whose doc_id is the component_id.

    A row of null id stays where its component has no other. Rows that share an id, or have none, are told apart by their
    texts' fingerprints, so that each of them stands for its own component. Ids that go, or that several rows share, are
    broadcast where they are few (``broadcast_ids``, counted first); more of them meet the documents in a shuffled join.
    """
    prints, by_print, hot = components_of(docs, words, seed, radius, shard)
    by_print = materialize(by_print)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")
    ids = materialize(with_components(prints, by_print, hot).groupBy("doc_id").agg(F.sum(stays).alias("stay"), F.count("*").alias("n")))

    def few(found: DataFrame) -> DataFrame:
        return F.broadcast(found) if found.limit(broadcast_ids + 1).count() <= broadcast_ids else found.hint("merge")

    # null ids need no join
    shared = ids.where("n > 1 and stay > 0 and doc_id is not null").select("doc_id")
    go = few(ids.where("(stay = 0 or n > 1) and doc_id is not null").select("doc_id"))
    alone = docs.where("doc_id is not null").join(go, "doc_id", "left_anti").select(docs.columns)
    if not ids.where("stay > 0 and (n > 1 or doc_id is null)").limit(1).count():
        return alone
    again = docs.where("doc_id is not null").join(few(shared), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
    return alone.unionByName(one_of_each_root(again, by_print, words, seed))


def one_of_each_root(docs: DataFrame, by_print: DataFrame, words: int, seed: int) -> DataFrame:
    """One row of ``docs`` for each component whose component_id is its doc_id, null included."""
    at, (helper, root, least) = docs.columns.index("text"), free_names(docs.columns, "print", "root", "least")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t or "", words, seed) for t in batch.column(at).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, helper])

    printed = map_batches(docs, run, StructType([*docs.schema.fields, StructField(helper, LongType())]))
    parts = by_print.select(F.col("fp").alias(helper), F.col("root").alias(root), F.col("component_id").alias(least))
    mine = printed.join(parts, helper).where(F.col("doc_id").eqNullSafe(F.col(least)))
    return mine.dropDuplicates([root]).select(docs.columns)
