"""Toxicity by noisy-channel deobfuscation (operator 8).

A token with leetspeak, stretched letters or spaced-out letters is a character lattice: each written character may stand
for itself, for a letter it resembles, for one of a run, or for nothing. A Viterbi search under a character trigram model
picks the most likely word; a token of plain letters, no two alike in a row, has a single path and is its own restoration.
In a row of single characters the search may also choose word breaks. Restored
words and their beginnings are then scored with weights learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labelled, discard, map_batches, materialize, prepare, slices

#: At most so many labelled documents are learned from (half for either label).
BOUND = 12_000
THRESHOLD = 0.3
#: Characters of text whose trigrams are counted together; letters that are counted in a dense table, the rest by sorting.
BLOCK, DENSE = 1 << 20, 128
#: Bytes, about, of the tokens that a worker remembers, and what one takes besides its characters.
KEPT_BYTES, ENTRY = 40 << 20, 150
#: What a written character may stand for, besides itself. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Characters between letters that may stand for nothing.
FILL = set("*.-_~^'`\"#%&/\\:;,=")
PREFIXES = (4, 5, 6)
#: A feature's log-odds, at least and at most, and the log-likelihood ratio by which it must beat chance.
LEAST, MOST, SURE = 2.5, 9.0, 10.0
#: Log-probabilities of reading a written character as another, of dropping one, and of a letter that repeats.
COST_LEET, COST_FILL, COST_RUN = -1.0, -0.5, -0.7
#: Single characters at either end of a spaced-out word that may be words of their own.
NEIGHBOURS = 2

_LETTERS = r"[^\W\d_]"
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_PLAIN = re.compile(f"{_LETTERS}+").fullmatch
_RUN = re.compile(f"({_LETTERS})\\1\\1")
_DOUBLE = re.compile(f"({_LETTERS})\\1")
_GAP = re.compile(r"[ .\-_*]+")
_WORDS = re.compile(f"{_LETTERS}+")
_SIGNS = "".join(re.escape(c) for c in LEET)
_ODD = re.compile(f"{_LETTERS}.*[{_SIGNS}*_~^#%&]|[{_SIGNS}].*{_LETTERS}", re.S)
_EDGE = ".,;:?\"'()[]{}<>*#%&~`-_=/\\"
#: Three or more single letters (or signs for letters) in a row, set apart by spaces, dots, hyphens, underscores or stars.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
#: Every match of SPACED has two of these in a row; searched first, as it is found or ruled out faster.
_PAIR = re.compile(r"[ .\-_*](?:[^\W_]|[@$!|+])[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])(?![^\W_])").search
#: Where a token has more than one reading: a run of one character, or a character that is no letter.
_AMBIGUOUS = re.compile(r"(.)\1+|[\W\d_]", re.S).finditer


class CharModel:
    """Letter trigrams with interpolation; log-probabilities of a letter after the two before it."""

    def __init__(self, tri: Counter):
        bi: Counter = Counter()
        uni: Counter = Counter()
        for t, n in tri.items():
            bi[t[1:]] += n
            uni[t[2]] += n
        self.tri, self.bi, self.uni = dict(tri), dict(bi), dict(uni)
        self.tri_of: dict[str, int] = dict(_sum_by(tri, 2))
        self.bi_of: dict[str, int] = dict(_sum_by(bi, 1))
        self.total = sum(uni.values()) or 1
        self.kept: dict[str, float] = {}

    def __call__(self, gram: str) -> float:
        out = self.kept.get(gram)
        if out is None:
            p = 0.65 * self.tri.get(gram, 0) / max(1, self.tri_of.get(gram[:2], 0)) + 0.25 * self.bi.get(gram[1:], 0) / max(1, self.bi_of.get(gram[1], 0)) + 0.1 * (self.uni.get(gram[2], 0) + 0.5) / (self.total + 50)
            out = math.log(p)
            if len(self.kept) < 200_000:
                self.kept[gram] = out
        return out


def _sum_by(counts: Counter, n: int) -> Counter:
    out: Counter = Counter()
    for gram, k in counts.items():
        out[gram[:n]] += k
    return out


_options: dict[tuple[str, int], list[tuple[str, float]]] = {}


def _reads(c: str, run: int) -> list[tuple[str, float]]:
    """What a character written ``run`` times (3: three or more) may stand for, with log-probabilities."""
    here = _options.get((c, run))
    if here is None:
        reads = [(c, 0.0)] if c.isalpha() else []
        reads += [(x, COST_LEET) for x in LEET.get(c, "")]
        here = []
        for x, cost in reads:
            if run == 1:
                here.append((x, cost))
            else:
                here += [(x, cost + (COST_RUN if run > 2 or not c.isalpha() else 2 * COST_RUN)), (x + x, cost + (0.0 if run == 2 else COST_RUN))]
        if c in FILL or not reads:
            here.append(("", COST_FILL if c in FILL else 3 * COST_FILL))
        if len(_options) < 10_000:
            _options[c, run] = here
    return here


def _arcs(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each written character, or run of one, the strings it may stand for with their log-probabilities."""
    return [_reads(m[0][0], min(len(m[0]), 3)) for m in re.finditer(r"(.)\1*", token, re.S)]


Paths = dict[str, tuple[float, tuple]]  # the last two letters read, with the best path to them


def _step(best: Paths, options: list[tuple[str, float]], model: CharModel) -> Paths:
    new: Paths = {}
    for state, (score, path) in best.items():
        for text, cost in options:
            s, at = score + cost, state
            for ch in text:
                s += model(at + ch)
                at = at[1] + ch
            have = new.get(at)
            if have is None or s > have[0]:
                new[at] = (s, (path, text))
    return new


def _through(best: Paths, letters: str, model: CharModel) -> Paths:
    """Letters with a single reading. Where all paths have met they need no scores, as every path shares them."""
    for i, c in enumerate(letters):
        if len(best) == 1:
            ((state, (score, path)),) = best.items()
            rest = letters[i:]
            return {(state + rest)[-2:]: (score, (path, rest))}
        best = _step(best, [(c, 0.0)], model)
    return best


def restore(token: str, model: CharModel, breaks: bool = False) -> str:
    """The most likely word behind a lower-case token: the best path through its lattice; with ``breaks``, words and spaces."""
    best: Paths = {"^^": (0.0, ())}
    if breaks:
        for k, options in enumerate(_arcs(token)):
            if k:
                score, path = max(((s + model(st + "$"), p) for st, (s, p) in best.items()), key=lambda x: x[0])
                if "^^" not in best or score > best["^^"][0]:
                    best["^^"] = (score, (path, " "))
            best = _step(best, options, model)
    else:
        done = 0
        for m in [*_AMBIGUOUS(token), None]:
            plain = token[done : m.start() if m else len(token)]
            if plain.isalpha():
                best = _through(best, plain, model)
            else:  # signs that count as letters of a word and are none
                for c in plain:
                    best = _step(best, _reads(c, 1), model)
            if m:
                done = m.end()
                best = _step(best, _reads(m[0][0], min(done - m.start(), 3)), model)
    path = max(((s + model(st + "$"), p) for st, (s, p) in best.items()), key=lambda x: x[0])[1] if len(best) > 1 else next(iter(best.values()))[1]
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def plain_words(token: str) -> list[str]:
    """Lower-case words of a token that has a single reading."""
    return [token] if _PLAIN(token) else _WORDS.findall(token)


def words_of(token: str, model: CharModel) -> list[str]:
    """Restored lower-case words of one white-space separated token."""
    token = token.lower()
    if _PLAIN(token) and not _DOUBLE.search(token):
        return [token]
    whole = token.strip(_EDGE)  # with the signs at its end, which may be letters
    if _PLAIN(whole) and not _DOUBLE.search(whole):
        return [whole]
    core = token.rstrip(".,;:?!\"'()[]{}<>*#%&~|`-_=+/\\") if token[-1:] not in "@$" else (token if len(token) < 2 or token[-2] not in "@$" else token.rstrip("@$"))
    core = core.lstrip(_EDGE)
    out = plain_words(core)
    for written in dict.fromkeys((core, whole)):
        if _ODD.search(written) or _DOUBLE.search(written) or (len(written) > 2 and ("@" in written or "$" in written)):
            found = restore(written, model)
            if found and found not in out:
                out = [*out, found]
    return out


def spaced_words(written: str, model: CharModel) -> set[str]:
    """Words that a row of single characters (a match of SPACED) may spell.

    Its most likely words, and it as one word, with and without the one-letter words that may stand beside it; also
    between the wider of its gaps, and between its spaces where other signs set letters apart.
    """
    written = written.lower()
    gaps = _GAP.findall(written)
    parts = [written]
    if len(set(map(len, gaps))) > 1:
        parts += re.split(r"[ .\-_*]{2}", written)
    if len({g.isspace() for g in gaps}) > 1:
        parts += written.split()
    out: set[str] = set()
    for part in dict.fromkeys(_GAP.sub("", p) for p in parts):
        if len(part) > 1:
            out.update(restore(part, model, breaks=True).split())
        for k in range(min(NEIGHBOURS, len(part) - 3) + 1):
            out.update(restore(x, model) for x in {part[k:], part[: len(part) - k]})
    out.discard("")
    return out


def features(word: str) -> list[str]:
    """The word and its beginnings, by which inflected forms share what is learned."""
    return ["=" + word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def trigrams(text: str) -> Counter:
    """Trigram counts of the plain words of a text: tokens of letters alone, after signs at their ends, without a letter three
    times in a row; a word begins with two carets and ends with a dollar sign."""
    counts = TrigramCounts()
    counts.add([text])
    return counts.result()


class TrigramCounts:
    """Trigrams of many texts, counted in blocks over their code points.

    The first DENSE letters that occur index a dense table; trigrams with any other are counted by sorting."""

    _BEGIN, _END = 94, 36
    _SPACE, _SIGN, _LETTER, _OTHER, _UNKNOWN = range(5)

    def __init__(self):
        self.kind = np.full(0x110000, self._UNKNOWN, dtype=np.uint8)
        self.number = np.full(0x110000, DENSE, dtype=np.uint8)  # of a letter; DENSE: none
        self.letters = [self._BEGIN, self._END]
        self.number[self.letters] = (0, 1)
        self.table = np.zeros(DENSE**3, dtype=np.int64)
        self.rest: Counter = Counter()

    def _learn(self, points: np.ndarray) -> None:
        for p in np.unique(points).tolist():
            c = chr(p)
            kind = self._SPACE if c.isspace() else self._SIGN if c in ".,;:!?\"'()*#$%&" else self._LETTER if c.isalnum() and not c.isdecimal() else self._OTHER
            self.kind[p] = kind
            if kind == self._LETTER and len(self.letters) < DENSE:
                self.number[p] = len(self.letters)
                self.letters.append(p)

    def add(self, texts: list[str]) -> None:
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BLOCK:
                self._block("\n".join(held))
                held, size = [], 0
        self._block("\n".join(held))

    def _block(self, text: str) -> None:
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.kind[points]
        if (unknown := kind == self._UNKNOWN).any():
            self._learn(points[unknown])
            kind = self.kind[points]
        edge = np.diff(np.concatenate(([False], kind != self._SPACE, [False])).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # of tokens
        letter = kind == self._LETTER
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        thrice = np.zeros(len(points), dtype=bool)
        thrice[2:] = letter[2:] & (points[2:] == points[1:-1]) & (points[2:] == points[:-2])
        if not len(first):
            return
        # a token is a word if it has one run of letters, nothing but signs beside it, and no letter three times in a row
        bad = np.add.reduceat((begins + 2 * ((kind == self._OTHER) | thrice)).astype(np.int64), first)
        word = np.zeros(len(points) + 1, dtype=np.int8)
        good = bad == 1
        word[first[good]] = 1
        word[end[good]] -= 1
        mine = letter & (np.cumsum(word[:-1], dtype=np.int8) > 0)
        at = np.flatnonzero(mine)
        if not len(at):
            return
        starts = begins[at]
        second = np.zeros(len(at), dtype=bool)
        second[1:] = starts[:-1] & ~starts[1:]
        last = np.ones(len(at), dtype=bool)
        last[:-1] = starts[1:]
        c = points[at]
        b = np.where(starts, self._BEGIN, points[at - 1])
        a = np.where(starts | second, self._BEGIN, points[at - 2])  # the text begins with a space, so this stays inside
        a, b, c = (np.concatenate((x, y[last])) for x, y in ((a, b), (b, c), (c, np.full(len(c), self._END, dtype=np.uint32))))
        i, j, k = (self.number[x].astype(np.int64) for x in (a, b, c))
        dense = (i < DENSE) & (j < DENSE) & (k < DENSE)
        self.table += np.bincount(((i * DENSE + j) * DENSE + k)[dense], minlength=len(self.table))
        if not dense.all():
            a, b, c = (x[~dense].astype(np.uint64) for x in (a, b, c))
            for key, n in zip(*(x.tolist() for x in np.unique(a << np.uint64(42) | b << np.uint64(21) | c, return_counts=True)), strict=True):
                self.rest[chr(key >> 42) + chr(key >> 21 & 0x1FFFFF) + chr(key & 0x1FFFFF)] += n

    def result(self) -> Counter:
        out = Counter(self.rest)
        for x in np.flatnonzero(self.table).tolist():
            gram = "".join(chr(self.letters[y]) for y in (x // DENSE**2, x // DENSE % DENSE, x % DENSE))
            out[gram] += int(self.table[x])
        return out


class Seen:
    """What tokens seen before came to, in two generations of about KEPT_BYTES / 2.

    A full generation becomes the older one, whose tokens move up when they are met again; the rest are forgotten."""

    def __init__(self):
        self.plain: set[str] = set()  # tokens that came to nothing
        self.found: dict[str, object] = {}
        self.old_plain: set[str] = set()
        self.old_found: dict[str, object] = {}
        self.size = 0

    def keep(self, token: str, result: object) -> None:
        size = ENTRY + len(token) * (1 if token.isascii() else 4)
        if size > KEPT_BYTES >> 8:
            return
        self._room(size)
        if result:
            self.found[token] = result
        else:
            self.plain.add(token)

    def _room(self, size: int) -> None:
        if self.size + size > KEPT_BYTES // 2:
            self.old_plain, self.old_found = self.plain, self.found
            self.plain, self.found, self.size = set(), {}, 0
        self.size += size

    def split(self, tokens: set[str]) -> tuple[list, set[str]]:
        """(results of those tokens that came to something, tokens not known)."""
        rest = tokens - self.plain
        again = rest & self.old_plain
        if again:
            rest -= again
            self._room(ENTRY * len(again) + sum(map(len, again)))
            self.plain |= again
        results = []
        for kept in (self.found, self.old_found):
            hits = rest & kept.keys()
            results += [(t, kept[t]) for t in hits]
            rest -= hits
        for t, r in results:
            if t not in self.found:
                self.keep(t, r)
        return [r for _, r in results], rest


@dataclass
class ToxicModel:
    chars: CharModel
    weights: dict[str, float]
    scale: tuple[float, ...] = (-1.0, 0.0, 0.0)
    seen: Seen = field(default_factory=Seen)

    def __post_init__(self):
        self.heads = {f.lstrip("=").rstrip("*")[: PREFIXES[0]] for f in self.weights}

    def word(self, word: str) -> float:
        if word[: PREFIXES[0]] not in self.heads:
            return 0.0  # every feature of the word begins like this
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def token(self, token: str) -> float:
        """The heaviest word of a token."""
        return max(map(self.word, words_of(token, self.chars)), default=0.0)

    def evidence(self, text: str) -> tuple[float, float]:
        """The heaviest token of the whole text, and the sum of the next two; spaced-out words count as tokens."""
        found, new = self.seen.split(set(text.split()))
        for t in new:
            w = self.token(t)
            self.seen.keep(t, w)
            if w > 0:
                found.append(w)
        if _PAIR(text):
            for m in SPACED.finditer(text):
                w = max(map(self.word, spaced_words(m[0], self.chars)), default=0.0)
                if w > 0:
                    found.append(w)
        found.sort(reverse=True)
        return (found[0] if found else 0.0), sum(found[1:3])

    def score(self, text: str) -> float:
        first, more = self.evidence(text)
        z = self.scale[0] + self.scale[1] * first + self.scale[2] * more
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def document_features(text: str, model: CharModel, seen: Seen) -> set[str]:
    """Features of the words of a text; ``seen`` has the words of tokens that came before."""
    known, new = seen.split(set(text.split()))
    words = {w for found in known for w in found}
    for t in new:
        found = words_of(t, model)
        seen.keep(t, found)
        words.update(found)
    return {f for w in words for f in features(w)}


def weight(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-odds of a feature by its document counts, 0 unless they are surely above chance (likelihood ratio) and high."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    n, base = toxic + clean, n_toxic / (n_toxic + n_clean)
    gain = toxic * math.log(toxic / n / base) + (clean * math.log(clean / n / (1 - base)) if clean else 0.0)
    return min(odds, MOST) if odds > LEAST and gain > SURE else 0.0


def corpus_trigrams(docs: DataFrame) -> Counter:
    """Trigram counts of the plain words of all texts; as many entries as the corpus's alphabets make trigrams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TrigramCounts()
        for batch in slices(batches):
            counts.add(batch.column(0).to_pylist())
        grams = counts.result()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    counts = texts.mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Counter({r["gram"]: r["n"] for r in counts.toLocalIterator()})


def fit(docs: DataFrame, labels: DataFrame, held: Column, bound: int = BOUND) -> ToxicModel:
    """Learn the character model from all texts, the weights and the scale from at most ``bound`` labelled rows outside ``held``.

    The rows are counted on the executors; the driver gets trigram counts, the features that pass ``weight``, and two
    numbers a row. The character model uses no labels, so held-out texts count in it as well. Null texts count as empty,
    rows with null ids only in the character model, repeated rows of an id once (see ``bounded_labelled``); only doc_id and
    text, and doc_id and toxic of the labels, are read. Without labelled rows of both kinds (empty tables included) the
    model scores every text alike, below the threshold.
    """
    prepare(docs.sparkSession)
    sample = materialize(bounded_labelled(docs, labels, "toxic", held, bound))
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}

    chars = CharModel(corpus_trigrams(docs))
    if not n.get(0) or not n.get(1):
        discard(sample)
        return ToxicModel(chars, {})

    seen = Seen()  # filled in the tasks

    def count_features(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[Counter, Counter] = (Counter(), Counter())
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[y].update(document_features(t, chars, seen))
        names = list(out[0] | out[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([out[1][f] for f in names], pa.int64()), pa.array([out[0][f] for f in names], pa.int64())], names=["feature", "toxic", "clean"])

    counts = map_batches(sample.select("text", "label"), count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counts.where((F.col("toxic") >= 3) & (F.col("toxic") * n[0] > F.col("clean") * n[1] * math.exp(LEAST) * 0.9))
    weights = {r["feature"]: w for r in likely.toLocalIterator() if (w := weight(r["toxic"], r["clean"], n[1], n[0]))}
    model = ToxicModel(chars, weights)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.evidence(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column(1)], names=["first", "more", "label"])

    rows = np.array([tuple(r) for r in map_batches(sample.select("text", "label"), evidence, "first double, more double, label int").collect()], dtype=float)  # ``bound`` rows at most
    model.scale = logistic(rows[:, :2], rows[:, 2])
    discard(sample)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes of a logistic regression with a small ridge, by damped Newton steps."""
    m = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(m.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(b)), m.T @ (y - p) - 1e-2 * b)
        b += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score of every whole text, in one pass without a shuffle.

    A null text counts as empty. Null ids and repeated rows pass through; only doc_id and text are read, so that further
    columns of any name do not matter. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning sample and the trigrams of the alphabet

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``threshold``, all their columns unchanged, whatever their names.

    A null text scores as an empty one and stays null. Null ids and repeated rows are judged by their texts alone. Empty in,
    empty out.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [shared.value.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
