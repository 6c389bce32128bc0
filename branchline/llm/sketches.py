"""Document fingerprints: bottom-k sketches of shingle hashes (operator 3).

A sketch keeps the k smallest distinct 64-bit hashes of a text's word shingles. Sketches of parts merge into the sketch of
their union, and two of them estimate resemblance, containment and the number of distinct shingles; with fewer than k
shingles the estimates are exact. Words are split at ASCII white space, A-Z count as a-z; shingles are five words, or the
whole sequence of a shorter text. Hashes are made for a block of texts at once, in numpy over its bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, prepare, slices

K = 128
WORDS = 5
#: Bytes of text that are hashed together; a longer text stands alone.
BLOCK = 4 << 20
#: Documents that one range of ids holds at least, the number of ranges at most, and sampled ids for each range.
RANGE_ROWS, RANGES, PER_RANGE = 96, 100_000, 20
#: Characters of a text that may bound a range inside one id, and sampled texts for each such range.
HEAD, PER_HOT = 64, 8
#: Null ids come first.
NULL_KEY = -(1 << 63)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Hashes of each text's shingles, repeats included."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))  # a space after each text
    buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if not len(buf):
        return [np.zeros(0, np.uint64) for _ in texts]
    low = _LOWER[buf]
    edge = np.diff(np.concatenate(([True], _SPACE[low], [True])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(buf)), out=total[1:])
    word = _mix((total[stops] - total[starts]) * _power("down", _INVERSE, len(buf))[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, begin[:-1])
    last = np.searchsorted(starts, begin[1:] - 1)
    rolled = np.zeros(max(len(word) - words + 1, 0), dtype=np.uint64)
    for i in range(words):
        rolled = rolled * _BASE + word[i : i + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(rolled[a : b - words + 1])
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for i in range(a, b):
                h = h * _BASE + word[i]
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    h = np.sort(hashes)
    return h[np.concatenate(([True], h[1:] != h[:-1]))][:k] if len(h) else h


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return bottom(np.concatenate((a, b)), k)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty texts resemble each other fully."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    # members of both sketches among the k smallest of the union
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty text is contained in every text."""
    if not len(a):
        return 1.0
    whole = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * whole / distinct(a, k))


def written(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def sketch_all(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < BLOCK:
            size += len(texts[end])
            end += 1
        out += [bottom(h, k) for h in shingle_hashes(texts[at:end], words)]
        at = end
    return out


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated distinct) of every whole text; a null text counts as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = sketch_all([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], k, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(a) for a in found], pa.string()), pa.array([distinct(a, k) for a in found], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, n_shingles double")


def merge_fingerprints(parts: DataFrame, *by: str, k: int = K) -> DataFrame:
    """The ``by`` columns, fingerprint and n_shingles of the union of all texts of a group, from fingerprints of its parts.

    Only DataFrame functions: the hashes of the written sketches are made distinct, and the k smallest of each group stay,
    which are taken in each task before anything moves, so that no group gathers more than k hashes of a task. A null
    fingerprint counts as an empty text's; groups without hashes have an empty one. Null group keys are groups of their own.
    """
    hash_, rank, joined = free_names([*by], "hash", "rank", "joined")
    words = F.filter(F.split(F.regexp_replace(F.coalesce("fingerprint", F.lit("")), "(.{16})", "$1,"), ","), lambda x: x != "")
    each = parts.select(*by, F.explode_outer(words).alias(hash_)).distinct()
    first = each.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(hash_).asc_nulls_last()))).where(F.col(rank) <= k)
    merged = first.groupBy(*by).agg(F.concat_ws("", F.sort_array(F.collect_list(hash_))).alias(joined))
    # as in ``distinct``: exact below k, else from the k-th smallest hash (its upper 52 bits are all that a double holds)
    size = (F.length(joined) / 16).cast("int")
    kth = F.conv(F.substring(F.col(joined), 16 * (k - 1) + 1, 13), 16, 10).cast("double") / 2.0**52
    return merged.select(*by, F.col(joined).alias("fingerprint"), F.when(size < k, size.cast("double")).otherwise((k - 1) / kth).alias("n_shingles"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sampled(rows: DataFrame, share: float) -> DataFrame:
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(7)), F.lit(1 << 40))
    return rows.where(part < int((1 << 40) * min(1.0, share)))


def _bounds(rows: DataFrame) -> list[tuple[int, str]]:
    """Ascending (key, head) at which ranges begin, RANGES at most; the first row of a range has them.

    Most bounds are an id alone, with an empty head. An id that is due several bounds has so many rows that it is split by
    the heads of their texts, which are sampled in a second pass over the rows of such ids.
    """
    n, low = rows.agg(F.count("*"), F.min("key")).first()
    if not n:
        return [(0, "")]
    cuts = max(1, min(RANGES, n // RANGE_ROWS))
    # only ids were read so far; of the texts, those of the least id are enough
    of_least = (rows["doc_id"] == low) | rows["doc_id"].isNull() if low == NULL_KEY else rows["doc_id"] == low
    bounds = {(low, rows.where(of_least).agg(F.min("head")).first()[0])}
    if cuts > 1:  # every so many of a sample of the ids, of at most about RANGES * PER_RANGE
        ids = np.sort(_sampled(rows, PER_RANGE * cuts / n).select("key").toArrow().column(0).to_numpy())
        points = ids[np.linspace(0, len(ids), cuts, endpoint=False).astype(np.int64)[1:]] if len(ids) else ids
        found, times = np.unique(points, return_counts=True)
        alone = set(found.tolist()) - {low}
        hot = dict(zip(found[times > 1].tolist(), times[times > 1].tolist(), strict=True))
        if hot:
            of_hot = F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in hot], "key long"))  # RANGES / 2 ids at most
            seen = _sampled(rows.select("key", "head"), PER_HOT * cuts / n).join(of_hot, "key", "left_semi").toPandas()
            for i, heads in seen.groupby("key")["head"]:
                heads = sorted(heads)
                bounds |= {(int(i), heads[j]) for j in np.linspace(0, len(heads), hot[int(i)], endpoint=False).astype(int).tolist()}
                alone.discard(int(i))
        bounds |= {(i, "") for i in alone}
    return sorted(bounds)


def deal_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, range, after: every row in the range it belongs to, and what may follow the last row of a range.

    Ranges are by (doc_id, text). A row that may be the first of its range is sent to the range before it as well, marked as
    ``after``: of rows with the bound's id those whose text begins least in their batch, one of each text.
    """
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"), F.substring(text, 1, HEAD).alias("head"))
    bounds = _bounds(rows)
    kept = docs.sparkSession.sparkContext.broadcast((np.array([i for i, _ in bounds], dtype=np.int64), [h for _, h in bounds]))

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series, heads: pd.Series, digests: pd.Series) -> pd.Series:
        ids, begins = kept.value
        keys = keys.to_numpy(dtype=np.int64)
        left, right = np.searchsorted(ids, keys), np.searchsorted(ids, keys, side="right")
        at = right - 1
        bounding = np.flatnonzero(right > left).tolist()
        for row in bounding:
            at[row] = bisect_right(begins, heads.iat[row], int(left[row]), int(right[row])) - 1
        out = [[r] for r in at.tolist()]
        first: dict[int, tuple[str, dict[int, int]]] = {}
        for row in bounding:
            r, head = int(at[row]), heads.iat[row]
            if ids[r] != keys[row] or (begins[r] and begins[r] != head):
                continue
            if r not in first or head < first[r][0]:
                first[r] = head, {}
            if head == first[r][0]:
                first[r][1][digests.iat[row]] = row
        for r, (_, of) in first.items():
            for row in of.values():
                out[row].append(-1 - (r - 1) % len(begins))
        return pd.Series(out)

    # a negative number: the row only tells what follows that range's last row
    dealt = rows.withColumn("at", F.explode(ranges("key", "head", F.xxhash64("text"))))
    return dealt.select("doc_id", "text", "key", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("range"), (F.col("at") < 0).alias("after"))


def fingerprint_edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is taken from the next document.

    Next is the next row by ascending (doc_id, text), null ids first; after the last comes the first. Rows are dealt once,
    to ranges of ids and, where one id has the rows of several ranges, of texts; the first row of a range is sent to the
    range before it as well, so every range knows what follows its last row, and one task streams through its ranges in
    order. Rows with equal ids whose texts begin with the same HEAD characters stay together. A null text counts as empty;
    rows with equal ids are kept, each with the row after it. Only doc_id (an integer) and text are read. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    n_out = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = deal_ranges(docs).repartition(n_out, "range").sortWithinPartitions("range", "after", "key", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text, range, after), whose successor is not known or which are not done yet
        size = 0

        def done(part: list[tuple]) -> pa.RecordBatch:
            """Results of the rows of ``part`` that a row of the same range follows."""
            of = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
            edits = [_edited(part[i][1], part[i + 1][1]).encode("utf-8", "surrogatepass") for i in of]
            need = sorted({*of, *(i + 1 for i in of)})
            own = dict(zip(need, sketch_all([part[i][1].encode("utf-8", "surrogatepass") for i in need], k, words), strict=True))
            new = sketch_all(edits, k, words)
            cols = [
                pa.array([part[i][0] for i in of], batch_type),
                pa.array([len(part[i][1]) for i in of], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                pa.array([written(own[i]) for i in of], pa.string()),
                pa.array([written(a) for a in new], pa.string()),
                pa.array([resemblance(own[i], a, k) for i, a in zip(of, new, strict=True)], pa.float64()),
                pa.array([resemblance(own[i], own[i + 1], k) for i in of], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=names)

        batch_type = pa.int64()
        for batch in slices(batches):
            batch_type = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3] and held and held[-1][3] and held[-1][2] == row[2]:
                    continue  # only the first of equal ids follows the range
                held.append(row)
                size += len(row[1])
                if size >= BLOCK:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield done(held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "range", "after").mapInArrow(run, schema)
