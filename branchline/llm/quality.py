"""Quality scores from random Fourier features (operator 9).

Statistics of a whole document are mapped to random Fourier features, whose inner products approximate a Gaussian kernel.
Each partition of the learning sample sums its part of the normal equations; the driver adds the sums, solves the ridge
regression and calibrates its scores by isotonic regression on folds that the scored rows were not fitted on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labelled, discard, map_batches, materialize, prepare, slices

#: At most so many labelled documents are learned from; random features; width of the kernel; ridge; folds; seed.
BOUND, FEATURES, WIDTH, RIDGE, FOLDS, SEED = 20_000, 256, 2.0, 1e-3, 4, 20
THRESHOLD = 0.5

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _SIGN, _POINT = range(7)
_CLASS = np.zeros(256, dtype=np.int64)
for _byte in range(256):
    _c = chr(_byte)
    _CLASS[_byte] = _HIGH if _byte > 127 else _UPPER if _c.isupper() else _LOWER if _c.islower() else _DIGIT if _c.isdigit() else _SPACE if _c.isspace() else _POINT if _c in ".,;:'\"-?()" else _SIGN
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
NAMES = ("log_bytes", "upper", "digit", "space", "high", "sign", "point", "word_length", "distinct_words", "top_word", "repeated_lines", "signed_words", "short_words", "line_length", "sentence_length", "upper_words", "repeated_triples")


def statistics(text: str) -> list[float]:
    """Size, shares of character classes, word and line shape, and repetition of a whole text; an empty text is all zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [math.log1p(len(raw)), *[0.0] * (len(NAMES) - 1)]
    share = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=7) / len(raw)
    counts = Counter(words)
    n = len(words)
    lines = [s for line in text.split("\n") if (s := line.strip())]
    distinct = list(counts.items())
    signed = sum(k for w, k in distinct if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")" or len(w) > 1 and w[-2:] == "!!")
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        math.log1p(len(raw)),
        *(float(share[c]) for c in (_UPPER, _DIGIT, _SPACE, _HIGH, _SIGN, _POINT)),
        sum(len(w) * k for w, k in distinct) / n / 10,
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        signed / n,
        sum(k for w, k in distinct if len(w) <= 2) / n,
        math.log1p(len(text) / len(lines)),
        math.log1p(n / (1 + len(_SENTENCE.findall(text)))),
        sum(k for w, k in distinct if len(w) > 1 and w.isupper()) / n,
        1 - triples / max(1, n - 2),
    ]


def document_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``x``, the statistics of the whole text (a null text counts as empty)."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([statistics(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], x], names=[*keep, "x"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"), *keep), run, f"{kinds}x array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.freq + self.phase
        return np.column_stack((np.ones(len(x)), np.cos(z) * math.sqrt(2 / len(self.phase))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the isotonic regression of y on x (pool adjacent violators): block means, which never fall.

    A block is a knot at its mean, so that scores between blocks are interpolated. Rows with the same x are one block.
    """
    points, of = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, t, n in zip(points.tolist(), np.bincount(of, weights=y).tolist(), np.bincount(of).tolist(), strict=True):
        blocks.append([a * n, t, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([s / n for s, _, n in blocks]), np.array([t / n for _, t, n in blocks])


def fit(docs: DataFrame, labels: DataFrame, held: Column, bound: int = BOUND, n_features: int = FEATURES) -> QualityModel:
    """Fit on at most ``bound`` labelled rows outside ``held``; at most so many pairs of numbers, and sums, reach the driver.

    Null texts count as empty; rows with null ids are not learned from, repeated rows of an id once (see
    ``bounded_labelled``). Only doc_id and text, and doc_id and quality of the labels, are read. Without rows of both labels
    (empty tables included) every score is 0.5.
    """
    prepare(docs.sparkSession)
    sample = document_statistics(bounded_labelled(docs, labels, "quality", held, bound), "doc_id", "label")
    part = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(FOLDS)).cast("int").alias("part")
    sample = materialize(sample.select("x", "label", part))
    d, rng = len(NAMES), np.random.default_rng(SEED)
    base = QualityModel(np.zeros(d), np.ones(d), rng.standard_normal((d, n_features)) / WIDTH / math.sqrt(d / 4), rng.uniform(0, 2 * math.pi, n_features), np.zeros(n_features + 1), np.array([0.0]), np.array([0.5]))
    totals = sample.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)), *(F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(d))).collect()
    per = {r["label"]: r["n"] for r in totals}
    n = sum(per.values())
    if len(per) < 2:
        discard(sample)
        return base
    base.mean = np.array([sum(r[f"s{i}"] for r in totals) for i in range(d)]) / n
    base.scale = np.sqrt(np.maximum(np.array([sum(r[f"q{i}"] for r in totals) for i in range(d)]) / n - base.mean**2, 0)) + 1e-3
    weigh = np.array([n / 2 / per[0], n / 2 / per[1]])  # both labels count alike in the regression

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            x, y, p = (np.array(c.to_pylist()) for c in batch.columns)
            for k in set(p.tolist()):
                z, t = base.features(x[p == k]), y[p == k]
                w = weigh[t]
                m = np.column_stack((z.T @ (z * w[:, None]), z.T @ (w * (2.0 * t - 1))))
                total[k] = total.get(k, 0) + m
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["part", "sums"])

    gathered: dict[int, np.ndarray] = {}
    for r in sample.coalesce(8).mapInArrow(sums, "part int, sums binary").collect():  # 8 tasks, FOLDS rows each
        gathered[r["part"]] = gathered.get(r["part"], 0) + np.frombuffer(r["sums"]).reshape(n_features + 1, -1)
    whole = sum(gathered.values())

    def solved(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:, :-1] + RIDGE * n / n_features * np.eye(len(m)), m[:, -1])

    betas = {k: solved(whole - m) for k, m in gathered.items()}

    def outside(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y, p = (np.array(c.to_pylist()) for c in batch.columns)
        z = base.features(x)
        return pa.RecordBatch.from_arrays([pa.array([float(z[i] @ betas[k]) for i, k in enumerate(p.tolist())], pa.float64()), pa.array(y, pa.int32())], names=["raw", "label"])

    pairs = np.array([tuple(r) for r in map_batches(sample, outside, "raw double, label int").collect()])  # ``bound`` rows at most
    base.beta = solved(whole)
    base.knots, base.values = isotonic(pairs[:, 0], pairs[:, 1])
    discard(sample)
    return base


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every whole text, in one pass without a shuffle.

    A null text counts as empty. Null ids and repeated rows pass through; only doc_id and text are read, so that further
    columns of any name do not matter. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
