"""Best-fit packing by exact-complement hashing (operator 1).

Token sequences are cut into pieces of at most ``capacity``. The plan is made over the histogram of piece lengths: at
most ``capacity`` counters, however large the corpus. Indexes hold, for every sum, whether a single length has it and how
many pairs and triples of available lengths do; they are kept up to date as lengths run out. For the gap that the longest
remaining piece leaves they tell at once whether a combination fills it exactly, which is then looked up and consumed; where
there is none, the longest piece that fits goes in (best fit) and the search runs again over what is left. A combination
is consumed as often as its counts allow, so a plan has few thousand patterns. Pieces then find their place by their rank
among the pieces of their length, which is counted in salted groups: no length, however frequent, meets in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, map_batches, materialize, prepare
from .token_counts import prove_whole, worker_tokenizer

CAPACITY = 4096
END_ID = 1


class Complements:
    """Available lengths with their counts, and what of them sums to a given gap.

    ``pairs`` and ``triples`` index the sums: how many combinations of available lengths (one length as often as there are
    pieces of it) have each sum up to the largest length.
    """

    def __init__(self, counts: np.ndarray):
        self.n = np.zeros(len(counts), dtype=np.int64)
        self.here = np.zeros(len(counts), dtype=bool)
        self.pairs = np.zeros(len(counts), dtype=np.int64)
        self.triples = np.zeros(len(counts), dtype=np.int64)
        for x in np.flatnonzero(counts).tolist():
            for copies in range(1, min(int(counts[x]), 3) + 1):
                self._count(x, copies, 1)
                self.here[x] = True
            self.n[x] = counts[x]

    def _add(self, index: np.ndarray, by: int, what: np.ndarray, sign: int) -> None:
        """Counts ``what`` of sums, moved up by a length."""
        if by < len(index):
            index[by:] += sign * what[: len(index) - by]

    def _count(self, x: int, copies: int, sign: int) -> None:
        """Index the combinations that a copy of ``x`` more (or less) makes: the first, second or third one."""
        others = self.here.astype(np.int64)
        others[x] = 0
        if copies == 1:
            if sign < 0:
                self._add(self.pairs, x, others, sign)
            self._add(self.triples, x, self.pairs, sign)  # with pairs that x is not in
            if sign > 0:
                self._add(self.pairs, x, others, sign)
        elif copies == 2:
            if 2 * x < len(self.n):
                self.pairs[2 * x] += sign
            self._add(self.triples, 2 * x, others, sign)
        elif 3 * x < len(self.n):
            self.triples[3 * x] += sign

    def take(self, length: int, times: int) -> None:
        before, now = int(self.n[length]), int(self.n[length]) - times
        for copies in range(min(before, 3), min(now, 3), -1):
            self._count(length, copies, -1)
        self.n[length] = now
        self.here[length] = now > 0

    def _two(self, gap: int, less: int = 0) -> tuple[int, int] | None:
        """Two lengths with that sum, the longer one as long as possible; of ``less`` one is not to be had."""
        low = (gap + 1) // 2
        a = np.flatnonzero(self.here[low:gap] & self.here[gap - np.arange(low, gap)])
        for x in a[::-1]:
            x = int(x) + low
            y = gap - x
            if self.n[x] >= 1 + (x == y) + (x == less) and self.n[y] >= 1 + (x == y) + (y == less):
                return x, y
        return None

    def pair(self, gap: int) -> tuple[int, int] | None:
        return self._two(gap) if self.pairs[gap] else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three lengths with that sum, the longest one as long as possible."""
        if not self.triples[gap]:
            return None
        a = np.arange(gap)
        for x in np.flatnonzero(self.here[:gap] & (self.pairs[gap - a] > 0) & (3 * a >= gap))[::-1].tolist():
            if rest := self._two(gap - x, x):
                return x, *rest
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.here[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def best_fit(self, gap: int) -> int | None:
        fits = np.flatnonzero(self.here[: gap + 1])
        return int(fits[-1]) if len(fits) else None


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) until every piece has its place; lengths from 1 to ``capacity``."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    left, plan = Complements(have), []
    for longest in range(capacity, 0, -1):
        while left.n[longest] > 0:
            content, gap = [longest], capacity - longest
            left.take(longest, 1)
            while gap:
                found = left.exact(gap) or ((x,) if (x := left.best_fit(gap)) else ())
                if not found:
                    break
                for x in found:
                    left.take(x, 1)
                content += found
                gap -= sum(found)
            per = Counter(content)
            more = min(int(left.n[x]) // k for x, k in per.items())
            for x, k in per.items():
                left.take(x, more * k)
            plan.append((tuple(content), 1 + more))
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), and for each the first sequence id and the offset in the sequence."""
    used: Counter = Counter()
    rows, base = [], 0
    for content, times in plan:
        at = 0
        for x in content:
            rows.append(((x << 44) + used[x], base, at))
            used[x] += times
            at += x
        base += times
    rows.sort()
    keys, first, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return keys, first, offset


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids: the documents' ids with the end id, cut where longer than ``capacity``.

    The ids are little-endian numbers of two bytes if the whole vocabulary's fit, else of four (see ``flat_ids``).
    """
    prepare(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok, _, kept = worker_tokenizer(path, whole.value)
        kind = "H" if max(tok.largest, end_id) < 1 << 16 else "I"
        width, last = struct.calcsize(kind), struct.pack(f"<{kind}", end_id)
        rows: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = b"".join([*tok.values(text, kept, lambda x: struct.pack(f"<{len(x)}{kind}", *x)), last]) if text else last
            for piece, at in enumerate(range(0, len(ids), capacity * width)):
                part = ids[at : at + capacity * width]
                for c, v in zip(rows, (doc, piece, at // width, len(part) // width, part), strict=True):
                    c.append(v)
        kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def flat_ids(ids: pa.Array, total: int) -> np.ndarray:
    """The numbers of all pieces of ``token_pieces`` in order; their width follows from how many there are."""
    ids = ids.cast(pa.binary())
    ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
    raw = np.frombuffer(ids.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    return raw.view("<u2" if len(raw) == 2 * total else "<u4").astype(np.int32)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length (1 to ``capacity``), whatever else they have.

    Repeated rows are separate pieces, as are rows with null or equal ids. The pieces are written first, each with a number
    of its own: groups of a length are drawn by a hash of that number, so that no id, however frequent, makes a group large,
    and places do not change when a task is run again. Columns named sequence_id or offset are replaced. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    prepare(spark)
    pieces = pieces.drop("sequence_id", "offset")
    row, n_groups, bucket, before, rank, place = free_names(pieces.columns, "row", "groups", "bucket", "before", "rank", "place")
    kept = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "zstd")
    hist = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(plan_slots(plan_patterns(hist, capacity)))

    # groups of about sqrt(n) rows, 256 at least: neither a group nor the list of a length's groups gets large
    groups = [(k, max(1, round(n / max(256, n**0.5)))) for k, n in hist.items()] or [(0, 1)]
    by_length = F.broadcast(spark.createDataFrame(groups, f"length long, {n_groups} long"))
    dealt = kept.join(by_length, "length").withColumn(bucket, F.pmod(F.xxhash64(row), n_groups)).drop(n_groups)
    sums = dealt.groupBy("length", bucket).agg(F.count("*").alias(n_groups))
    earlier = F.coalesce(F.sum(n_groups).over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("length", bucket, earlier.alias(before))
    nth = F.row_number().over(Window.partitionBy("length", bucket).orderBy(row)) - 1
    ranked = dealt.withColumn(rank, nth).join(starts, ["length", bucket]).withColumn(rank, F.col(rank) + F.col(before))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        keys, first, offset = slots.value
        key = (length.to_numpy().astype(np.int64) << 44) + nth.to_numpy().astype(np.int64)
        at = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + (key - keys[at]), "offset": offset[at]})

    rows = ranked.withColumn(place, placed("length", rank))
    return rows.select(*(f"`{c}`" for c in pieces.columns), f"{place}.sequence_id", f"{place}.offset")


PIECE = ["doc_id", "piece", "start", "length", "offset"]


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of placed pieces, which come ordered by sequence and offset; a sequence may go on in the next batch."""
    left: pa.RecordBatch | None = None

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        number, length = (part.column(c).to_numpy(zero_copy_only=False) for c in ("sequence_id", "length"))
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        ends = pa.array(np.concatenate((first, [len(number)])).astype(np.int32))
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = pa.ListArray.from_arrays(pa.array(upto[np.concatenate((first, [len(number)]))].astype(np.int32)), pa.array(flat_ids(part.column("ids"), int(upto[-1]))))
        pieces = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([part.column(c) for c in PIECE], names=PIECE))
        return pa.RecordBatch.from_arrays([pa.array(number[first]), ids, pieces], names=["sequence_id", "ids", "pieces"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.concat_batches([left, batch])
        number = batch.column("sequence_id").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield made(batch.slice(0, cut))
        left = batch.slice(cut)
    if left is not None:
        yield made(left)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces of sequences, which have no gaps, with checksums of their ids."""
    number, ids, pieces = batch.column("sequence_id"), batch.column("ids"), batch.column("pieces")
    inside, values = pieces.flatten(), ids.flatten()
    per = pieces.value_lengths().to_numpy(zero_copy_only=False)
    doc, piece, start, length, offset = (inside.field(c) for c in PIECE)
    upto = np.concatenate(([0], np.cumsum(length.to_numpy(zero_copy_only=False))))
    raw = memoryview(np.ascontiguousarray(values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
    ends = (4 * upto).tolist()
    crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
    numbers = pa.array(np.repeat(number.to_numpy(zero_copy_only=False), per))
    cut = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), values)
    return pa.RecordBatch.from_arrays([doc, piece, start, length, crc, numbers, offset, cut], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])


def _placed(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Placed pieces with their ids, a sequence's together and in its order."""
    rows = pack_pieces(token_pieces(docs, path, capacity, end_id), capacity)
    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")


def pack_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The training sequences: sequence_id, ids, pieces.

    ids are all token ids of the sequence; pieces has doc_id, piece, start, length and offset of what is in it, by offset.
    A null text counts as empty and is one piece, the end id alone. Null and repeated ids are kept, one piece each. Only
    doc_id and text are read. Empty in, empty out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    inside = f"doc_id: {kind}, piece: int, start: bigint, length: bigint, offset: bigint"
    return _placed(docs, path, capacity, end_id).mapInArrow(_assembled, f"sequence_id long, ids array<int>, pieces array<struct<{inside}>>")


def _piece_schema(kind: str) -> str:
    return f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


def pieces_of(sequences: DataFrame) -> DataFrame:
    """Each piece of packed sequences, cut out of them: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids."""
    kind = sequences.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()
    return map_batches(sequences.select("sequence_id", "ids", "pieces"), _cut, _piece_schema(kind))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``pack_sequences``, a sequence's together and in its order; their ids, joined, are the sequence.

    As ``pieces_of(pack_sequences(...))``, but sequences stay in the worker that cuts them.
    """
    return _placed(docs, path, capacity, end_id).mapInArrow(lambda batches: map(_cut, _assembled(batches)), _piece_schema(docs.schema["doc_id"].dataType.simpleString()))
