"""Personal data by weak supervision (operator 6).

Patterns propose spans: strict ones, which always stay, and loose ones (spelled-out addresses, numbers without a country
code, short cards, national ids). Labelers vote on every span from its form, checksums, gazetteers, the words before it and
what touches it. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how reliable each
labeler is, kind by kind; a logistic span classifier is then trained on the resulting probabilities and decides which loose
spans are added. Vote patterns are few, so nothing that reaches the driver grows with the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, prepare, slices

KINDS = ("email", "ip", "card", "phone", "id")
#: Probability from which a loose span is added.
SURE = 0.9
#: Characters before a span that the context labeler reads.
NEAR = 48

# Gazetteers and context words.
TLDS = set("com org net edu gov mil int info biz name io co uk de fr es it nl be ch at se no dk fi pl pt cz ru jp cn in br au ca us mx eu example test invalid".split())
HOSTS = set("mail gmail yahoo hotmail outlook icloud proton gmx web aol live example post".split())
CONTEXT = {
    "email": set("email e-mail mail contact write correo courriel adresse".split()),
    "ip": set("ip address server host addr ipv4 serveur".split()),
    "card": set("card visa mastercard amex credit debit payment karte carte tarjeta pay".split()),
    "phone": set("phone tel telephone call mobile cell fax telefon teléfono whatsapp sms number".split()),
    "id": set("ssn social security iban passport account tax insurance konto cuenta compte".split()),
}
AGAINST = set("version release build section chapter page order invoice isbn doi sku part serial hash commit token key uuid fig figure table v".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match begins at the first digit of a run, as one from a later digit would fail in the same place
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[\[({] ?(?:at|AT) ?[\])}]| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({] ?(?:dot|DOT) ?[\])}]| dot |\.) ?[A-Za-z0-9-]{1,63})+")
AT_SIGNS = (" at ", *(f"{b}{s}{at}" for b in "[({" for s in ("", " ") for at in ("at", "AT")))
_LOOSE_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_LOOSE_CARD = re.compile(r"(?<![0-9-])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9-])")
_LOOSE_ID = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])")
_WORD = re.compile(r"[^\W\d_][\w-]*|v(?=\d|$)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict spans (kind, start, end) by kind and start; linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that touch no strict one, and not each other."""
    found = []
    # as wide as the pattern: every match has one of these
    if "@" in text or any(x in text for x in AT_SIGNS):
        found += [("email", m.start(), m.end()) for m in _AT.finditer(text) if re.search(r"dot|\(|\[|\{|\.", m[0], re.I)]
    for kind, pattern in (("card", _LOOSE_CARD), ("phone", _LOOSE_PHONE), ("id", _LOOSE_ID)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    # strict spans joined where they overlap; what was found comes by start, so a search and the last one taken are enough
    ends: list[int] = []
    starts: list[int] = []
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        i = bisect_right(ends, a)
        if (i == len(ends) or starts[i] >= b) and (not out or a >= out[-1][2]):
            out.append((kind, a, b))
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 abstains. Form, checksum, gazetteer, context before, neighbours."""
    span = text[start:end]
    digits = _digits(span)
    form = 1 if strict else 0
    check = gazetteer = 0
    if kind == "email":
        host = re.split(r" ?[\[({] ?(?:at|AT) ?[\])}] ?| at |@", span)[-1]
        labels = [x for x in re.split(r"[^A-Za-z0-9-]+|\bdot\b", host.lower()) if x]
        gazetteer = (1 if labels and labels[-1] in TLDS else -1) if len(labels) > 1 else -1
        check = 1 if len(labels) > 1 and any(re.sub(r"\d+$", "", x) in HOSTS for x in labels[:-1]) else 0
        form = 1 if strict or re.search(r"[\[({]", span) else -1
    elif kind == "ip":
        parts = span.split(".")
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) or parts[0] in ("0", "255") else 1
        gazetteer = -1 if span in ("1.2.3.4", "127.0.0.1") else 0
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
        form = -1 if len(set(digits)) <= 2 else form
    elif kind == "phone":
        check = -1 if len(set(digits)) <= 2 else 1 if 10 <= len(digits) <= 13 else 0
        gazetteer = 1 if strict and digits[0] in "123456789" or digits[:1] not in ("0", "1") else -1
        form = 1 if strict or "(" in span else 0
    else:
        check = (-1 if digits[:3] in ("000", "666") or digits[0] == "9" else 1) if span[0].isdigit() else 1 if _iban(span) else -1
        gazetteer = 1 if span[0].isalpha() and _iban(span) else 0
    near = [w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start])][-4:]
    context = 1 if CONTEXT[kind] & set(near) else -1 if AGAINST & set(near[-2:]) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    touching = -1 if (left and (left.isalnum() or left in "=_/\\#")) or (right and (right.isalnum() or right in "=_/\\")) else 1 if not left or left.isspace() else 0
    return form, check, gazetteer, context, touching


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


N_VOTES = 5


def code(kind: str, strict: bool, vote: tuple[int, ...]) -> int:
    """Kind, strictness and votes as one small number."""
    out = KINDS.index(kind) * 2 + strict
    for v in vote:
        out = out * 3 + v + 1
    return out


def decode(number: int) -> tuple[int, int, list[int]]:
    vote = []
    for _ in range(N_VOTES):
        number, v = divmod(number, 3)
        vote.append(v - 1)
    return number // 2, number % 2, vote[::-1]


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(code, start, end) of all proposed spans."""
    base = base_spans(text)
    return [(code(k, s, votes(text, k, a, b, s)), a, b) for s, part in ((True, base), (False, loose_spans(text, base))) for k, a, b in part]


@dataclass
class SpanModel:
    """Labeler reliabilities and the span classifier's weights; only few numbers."""

    reliability: np.ndarray = field(default_factory=lambda: np.full((len(KINDS), N_VOTES, 2, 3), 1 / 3))
    prior: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), 0.5))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(KINDS) + 2 * N_VOTES))

    def features(self, number: int) -> np.ndarray:
        kind, _, vote = decode(number)
        x = np.zeros(len(self.weights))
        x[0] = x[1 + kind] = 1
        for i, v in enumerate(vote):
            if v:
                x[1 + len(KINDS) + 2 * i + (v > 0)] = 1
        return x

    def probability(self, number: int) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.features(number) @ self.weights, -30, 30))))


def estimate(counts: dict[int, int], rounds: int = 60) -> SpanModel:
    """EM over vote patterns (labelers independent given the truth, smoothed), then the classifier on its posteriors."""
    model = SpanModel()
    start = np.array([[0.55, 0.3, 0.15], [0.1, 0.3, 0.6]])  # votes -1, 0, 1 of a labeler, given not personal and personal
    model.reliability[:] = start
    if not counts:
        model.weights[0] = -1.0
        return model
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], dtype=float)
    kinds = np.array([decode(c)[0] for c in codes])
    vote = np.array([decode(c)[2] for c in codes]) + 1
    pos = np.zeros(len(codes))
    for _ in range(rounds):
        like = np.log(model.reliability[kinds[:, None], np.arange(N_VOTES)[None, :], :, vote]).sum(axis=1)
        z = like[:, 1] - like[:, 0] + np.log(model.prior[kinds] / (1 - model.prior[kinds]))
        pos = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for k in set(kinds.tolist()):
            of = kinds == k
            total = n[of].sum()
            model.prior[k] = ((n * pos)[of].sum() + 5) / (total + 10)
            for truth, w in enumerate(((n * (1 - pos))[of], (n * pos)[of])):
                for i in range(N_VOTES):
                    got = np.bincount(vote[of, i], weights=w, minlength=3)
                    # ten pseudo votes keep the meaning of the two truths
                    model.reliability[k, i, truth] = (got + 10 * start[truth]) / (got.sum() + 10)
    x = np.array([model.features(c) for c in codes])
    w = np.zeros(x.shape[1])
    weigh = n / n.sum() * len(n) + 1.0  # rare patterns count too
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weigh * p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), x.T @ (weigh * (pos - p)) - 0.05 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of [code, start, end], of every whole text; a null text counts as empty."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([spans_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "spans"])

    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<array<int>>")


def fit(found: DataFrame) -> SpanModel:
    """Estimate from the vote patterns of all candidate spans; the driver gets one count for each pattern that occurs."""
    counts = found.select(F.explode("spans").alias("s")).groupBy(F.col("s")[0].alias("code")).agg(F.count("*").alias("n"))
    return estimate({r["code"]: r["n"] for r in counts.collect()})


def chosen(spans: list[list[int]], model: SpanModel, kept: dict[int, bool], sure: float = SURE) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, strict) of the spans that stay, by kind and start."""
    out = []
    for c, a, b in spans:
        if c not in kept:
            kept[c] = bool(decode(c)[1]) or model.probability(c) >= sure
        if kept[c]:
            kind, strict, _ = decode(c)
            out.append((kind, a, b, bool(strict)))
    return sorted(out)


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    The counts and the hash are of the strict spans; ``spans`` has those and the added ones. Positions are code points, end
    exclusive. A null text counts as empty; null and repeated ids pass through; only doc_id and text are read.
    """
    found = materialize(candidates(docs))
    model = fit(found)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept: dict[int, bool] = {}
        rows = [chosen(s, model, kept) for s in batch.column(1).to_pylist()]
        counts = [[sum(k == i and strict for k, _, _, strict in r) for r in rows] for i in range(4)]
        said = [[",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, strict in r if strict or more) for r in rows] for more in (False, True)]
        cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in said[0]], pa.string()), pa.array(said[1], pa.string()), pa.array([sum(not x[3] for x in r) for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(found, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the union is replaced once."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced, and ``n_chars`` (if there) the new length.

    Other columns are unchanged, whatever their names; a null text stays null. Null ids and repeated rows are treated like
    any other. The model is estimated from all rows first. Empty in, empty out.
    """
    model = fit(candidates(docs))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, bool] = {}
        for batch in slices(batches):
            cols = list(batch.columns)
            texts = [t if t is None else redact(t, chosen(spans_of(t), model, kept)) for t in cols[at].to_pylist()]
            cols[at] = pa.array(texts, cols[at].type)
            if size is not None:
                cols[size] = pa.array([n if t is None else len(t) for t, n in zip(texts, cols[size].to_pylist(), strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
