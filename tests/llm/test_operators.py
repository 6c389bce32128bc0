"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from branchline.llm import html_text, mixing, neighbours, packing, pii, quality, simhash, sketches, token_counts, toxicity
from branchline.llm.common import fold, fold_of
from branchline.llm.components import connected_components
from branchline.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
#: doc_id, text, lang, source, n_chars, and columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, spans string, copy int, key long, label int, range int"
LONG = "word " * 30_000 + "end"
ODD = [(1, "hello world a@b.co"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "no id here"), (None, None), (7, "   \n\t "), (8, "héllo wörld ß 日本"), (9, "hello world a@b.co"), (-5, "call +1 (555) 234-5678 x")]


def odd(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 2}", None, 1, 0.5, "x", 3, 4, 5, 6) for i, t in rows], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


# -- 10 token counts, 1 packing


def test_tokens_equal_the_library(tokenizer):
    tok, kept = token_counts.WordTokenizer(vocabulary()), (token_counts.Kept(), token_counts.Kept())
    rng = random.Random(3)
    alphabet = "aAbz09'stlL .,!?-\n\t\x1c\x85\xa0 éÉßçİıſΣςあ中²½👍🏽́‍<|endoftext|>"
    texts = ["", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "it's I'LL don't", "x" * 3000, "ÀB́", "1234 ½²"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        got = [i for v in tok.values(t, kept, tuple) for i in v]
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_shortcut_is_proven(tokenizer):
    whole = token_counts.prove_whole(vocabulary())
    assert len(whole) > 10_000
    for word in random.Random(1).sample([w for w in whole if w.isascii() and w.isalpha()], 300):
        assert tokenizer.encode(word, add_special_tokens=False).ids == [whole[word]]


def test_token_counts(spark, tokenizer):
    rows = token_counts.count_tokens(odd(spark), vocabulary(), limit=2048).collect()
    assert len(rows) == len(ODD)
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        assert any((r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts[r["doc_id"]])
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert token_counts.count_tokens(odd(spark, []), vocabulary()).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(spark, tokenizer):
    rows = packing.pack_documents(odd(spark), vocabulary()).collect()
    check_packed(rows, 4096)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for i, t in ODD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [((i is None, i or 0), k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert got == sorted(want)
    assert packing.pack_documents(odd(spark, []), vocabulary()).count() == 0


def test_sequences_hold_every_token(spark, tokenizer):
    rows = packing.pack_sequences(odd(spark), vocabulary()).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found = []
    for r in rows:
        assert len(r["ids"]) == sum(p["length"] for p in r["pieces"]) <= 4096
        assert [p["offset"] for p in r["pieces"]] == sorted(p["offset"] for p in r["pieces"])
        found += [(str(p["doc_id"]), p["start"], r["ids"][p["offset"] : p["offset"] + p["length"]]) for p in r["pieces"]]
    want = []
    for i, t in ODD:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), a, ids[a : a + 4096]) for a in range(0, len(ids), 4096)]
    assert sorted(found) == sorted(want)
    pieces = packing.pack_documents(odd(spark), vocabulary()).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["ids"]) for r in pieces) == sorted(want)
    import pyarrow as pa

    for kind in ("<u2", "<u4"):
        raw = pa.array([np.array(x, kind).tobytes() for x in ([7], [1, 2, 3], [9, 9])])
        assert packing.flat_ids(raw[1:], 5).tolist() == [1, 2, 3, 9, 9]
    again = packing.pieces_of(packing.pack_sequences(odd(spark), vocabulary())).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["ids"], r["ids_crc32"]) for r in again) == sorted((str(r["doc_id"]), r["start"], r["ids"], r["ids_crc32"]) for r in pieces)


def test_exact_complements():
    plan = packing.plan_patterns({60: 5, 40: 5}, 100)
    assert plan == [((60, 40), 5)]
    assert packing.plan_patterns({50: 3, 30: 3, 20: 3}, 100) == [((50, 50), 1), ((50, 30, 20), 1), ((30, 30, 20, 20), 1)]
    left = packing.Complements(np.bincount([5, 5, 7, 9], minlength=30))
    assert left.pair(10) == (5, 5) and left.pair(14) == (9, 5) and left.triple(19) == (9, 5, 5) and left.triple(27) is None and left.exact(7) == (7,)


@pytest.mark.parametrize("seed", range(4))
def test_sum_indexes_against_all_combinations(seed):
    import itertools

    rng = random.Random(seed)
    n = np.array([0, *(rng.choice([0, 0, 1, 2, 5]) for _ in range(24))])
    left = packing.Complements(n)
    for _ in range(30):
        have = [x for x in range(len(n)) for _ in range(min(int(left.n[x]), 3))]
        for k, index in ((2, left.pairs), (3, left.triples)):
            sums = [sum(c) for c in set(itertools.combinations(have, k))]
            assert index.tolist() == [sums.count(s) for s in range(len(n))]
        for gap in range(1, len(n)):
            for found, index in ((left.pair(gap), left.pairs), (left.triple(gap), left.triples)):
                assert (found is not None) == (index[gap] > 0) and (found is None or sum(found) == gap and all(found.count(x) <= left.n[x] for x in found))
        if have:
            x = rng.choice(have)
            left.take(x, rng.randint(1, int(left.n[x])))


def test_plan_of_many_lengths_is_tight():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4097, 20_000)
    plan = packing.plan_patterns({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}, 4096)
    assert sum(n for _, n in plan) <= 1.005 * -(-int(lengths.sum()) // 4096)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        g = min(fits) if fits else None
        if g is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(g)
            gaps.append(g - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once_and_beats_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([97, 33, rng.randint(1, 100)]) for _ in range(400)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan_patterns(counts, 100)
    used = {}
    for content, n in plan:
        assert sum(content) <= 100
        for x in content:
            used[x] = used.get(x, 0) + n
    assert used == counts
    assert -(-sum(lengths) // 100) <= sum(n for _, n in plan) <= best_fit_decreasing(lengths, 100) + 1


def test_packing_hot_length(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 30).otherwise(35).cast("long").alias("length"))
    rows = packing.pack_pieces(pieces, 100).collect()
    assert len(rows) == 3000 and check_packed(rows, 100) == 1000


def test_packing_null_ids_and_clashing_names(spark):
    """Rows of one id spread over groups, and columns named like helpers pass through."""
    names = ["rank", "bucket", "groups", "before", "_own_row", "_OWN_place", "sequence_id"]
    pieces = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(25).cast("long").alias("length"), *(F.col("id").alias(c) for c in names))
    out = packing.pack_pieces(pieces, 100)
    assert out.columns == ["doc_id", "piece", "start", "length", *names[:-1], "sequence_id", "offset"]
    rows = out.collect()
    assert check_packed(rows, 100) == 1000 and sorted(r["rank"] for r in rows) == list(range(4000)) and all(r["rank"] == r["before"] == r["_OWN_place"] for r in rows)


# -- 2 neighbours


def vectors(spark, rows, schema="vec_id long, embedding array<float>, label int, shard int, part int, score double, id long"):
    return spark.createDataFrame([(i, v, 0, 1, 2, 0.5, 9) for i, v in rows], schema)


def brute(ids, v, q, k):
    s = (v * v[q]).sum(axis=1)
    order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
    return [(i, -x) for x, i in order[:k]]


def test_neighbours_few_rows(spark):
    good = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    bad = [(5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, []), (11, [1.0, 2.0, 3.0])]
    df = vectors(spark, good + bad)
    got = neighbours.nearest(df, df, k=3).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {1: [(2, 0.5), (3, 0.5), (4, -1.0)], 2: [(1, 0.5), (3, 0.5), (4, -0.5)], 3: [(1, 0.5), (2, 0.5), (4, -0.5)], 4: [(2, -0.5), (3, -0.5), (1, -1.0)]}
    assert neighbours.nearest(vectors(spark, []), vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, bad[:5]), df).count() == 0


def test_neighbours_recall_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 500)
    monkeypatch.setattr(neighbours, "LIST", 32)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 16))
    v[:1000] = v[0]  # a third are one vector
    v[1000:2000] *= rng.uniform(0.5, 3, (1000, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = list(range(0, 3000, 150))
    found = neighbours.nearest(df, df.where(F.col("vec_id").isin(asked))).cache()
    assert found.count() == 20 * len(asked)
    assert neighbours.recall(found, df, asked) >= 0.9
    hot = [(r["vec_id"], r["score"]) for r in found.where("query_id = 150").orderBy("rank").collect()]
    want = brute(list(range(3000)), v, 150, 20)
    assert [i for i, _ in hot if i < 1000] == [i for i, _ in want if i < 1000][: len([i for i, _ in hot if i < 1000])]


# -- 3 sketches


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_sketches_estimate_and_merge():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    a = " ".join(rng.choice(words) for _ in range(3000))
    b = a[: len(a) // 2] + " " + " ".join(rng.choice(words) for _ in range(1500))
    x, y = sketches.sketch_all([a.encode(), b.encode()])
    s, t = shingles(a), shingles(b)
    assert abs(sketches.resemblance(x, y) - len(s & t) / len(s | t)) < 0.12
    assert abs(sketches.containment(x, y) - len(s & t) / len(s)) < 0.2
    assert abs(sketches.distinct(x) / len(s) - 1) < 0.25
    parts = sketches.merge(*sketches.sketch_all([b"a b c d e f g", b"c d e f g h i"]))
    assert sketches.distinct(parts) == 5.0
    assert (sketches.read(sketches.written(x)) == x).all()


def test_short_texts_are_exact():
    one, same, empty, other = sketches.sketch_all([b"Two words", b" two\nWORDS ", b"", b"words two"])
    assert sketches.resemblance(one, same) == 1 and sketches.resemblance(one, empty) == 0 and sketches.resemblance(empty, empty) == 1 and sketches.resemblance(one, other) == 0
    assert sketches.containment(empty, one) == 1


def test_sketches_merge_as_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    parts = sketches.fingerprint_documents(documents(spark)).withColumn("g", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    empty = spark.createDataFrame([(1, "", 0.0, 77), (2, None, 0.0, 78)], "doc_id long, fingerprint string, n_shingles double, g long")
    got = {r["g"]: r for r in sketches.merge_fingerprints(parts.unionByName(empty), "g").collect()}
    assert set(got) == {None, 1, 2, 77, 78} and got[77]["fingerprint"] == got[78]["fingerprint"] == "" and got[77]["n_shingles"] == 0
    for g in (None, 1, 2):
        want = sketches.bottom(np.concatenate(sketches.shingle_hashes([(t or "").encode() for i, t in docs if (i % 3 or None) == g])), sketches.K)
        assert got[g]["fingerprint"] == sketches.written(want) and got[g]["n_shingles"] == pytest.approx(sketches.distinct(want), rel=1e-6)


def test_near_columns_against_exact_resemblance(spark):
    """near_edited and near_next of every document of the table, against the Jaccard similarity of the whole shingle sets."""
    docs = sorted((r["doc_id"], r["text"] or "") for r in documents(spark).select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in sketches.fingerprint_edits(documents(spark)).collect()}

    def exact(a, b):
        s, t = shingles(a), shingles(b)
        return len(s & t) / len(s | t) if s or t else 1.0

    off = []
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        off += [got[i]["near_edited"] - exact(t, t[: len(t) - half] + following[:half]), got[i]["near_next"] - exact(t, following)]
    assert max(map(abs, off)) < 0.2 and np.sqrt(np.mean(np.square(off))) < 0.045


def edits(rows):
    rows = sorted(((i is not None, i or 0), i, t or "") for i, t in rows)
    out = []
    for k, (_, i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_rows", [1, 3, 96])
def test_edited_texts(spark, monkeypatch, range_rows):
    monkeypatch.setattr(sketches, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(sketches, "BLOCK", 200)
    got = sketches.fingerprint_edits(odd(spark)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edits(ODD)
    one = sketches.fingerprint_edits(odd(spark, [(5, "only one")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(5, 1.0)]
    assert sketches.fingerprint_edits(odd(spark, [])).count() == 0


def test_edited_texts_whole_table(spark, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_ROWS", 7)
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sketches.fingerprint_edits(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edits(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprint_documents(docs).collect()}
    assert all(prints[r["doc_id"]] == r["fingerprint"] for r in got)


@pytest.mark.parametrize("hot", ["null id", "one id", "one text", "one beginning"])
def test_an_id_with_a_third_of_all_rows_is_split(spark, monkeypatch, hot):
    monkeypatch.setattr(sketches, "RANGE_ROWS", 10)
    rng = random.Random(hot)
    words = ["alpha", "beta", "gamma", "", "Ünder", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=9))) for i in range(1200)]
    fixed = {"one text": "the same words each time", "one beginning": "x" * 70}.get(hot)
    tail = (lambda k: "") if hot == "one text" else str
    rows += [(None if hot == "null id" else 500, (fixed or " ".join(rng.choices(words, k=9))) + tail(k)) for k in range(600)]
    docs = odd(spark, rows).repartition(5)
    dealt = sketches.deal_ranges(docs).groupBy("range", "after").count().collect()
    assert sum(r["count"] for r in dealt if not r["after"]) == len(rows)
    if not fixed:  # else as the docstring says
        assert max(r["count"] for r in dealt) < 80
    if hot == "one text":  # a row of each batch
        assert max(r["count"] for r in dealt if r["after"]) <= 10
    got = sketches.fingerprint_edits(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edits(rows)


# -- 4 mixing


def poisson(u, rate):
    p = c = math.exp(-rate)
    k = 0
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def u_of(seed, doc, k=1):
    return (int(hashlib.md5(f"{seed}|{'null' if doc is None else doc}|{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_mixing_counts(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise("cold").alias("source"), F.lit(1).alias("_mix_u"))
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    got = {}
    for r in mixing.mix(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    for r in docs.collect():
        n = poisson(u_of(mixing.SEED, r["doc_id"]), rates[r["source"]])
        assert sorted(got.get(r["doc_id"], [])) == list(range(1, n + 1))


def test_mixing_weights_large_rates_and_salts(spark, monkeypatch):
    docs = odd(spark, [(i, "t") for i in range(100)])
    weights = spark.createDataFrame([("s0", 1.0), ("gone", 5.0)], "source string, weight double")
    out = mixing.mix(docs, weights, total=100 * 150.0)
    assert [f for f in out.columns if f not in ("copy", "shuffle_key")] == [c for c in docs.columns if c != "copy"]
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert ids == {i for i in range(100) if i % 2 == 0 and i != 3} and abs(len(rows) / 15_000 - 1) < 0.05
    rate = 15_000 / 50
    draws = math.ceil(rate / mixing.STEP)
    assert sum(r["doc_id"] == 4 for r in rows) == sum(poisson(u_of(mixing.SEED, 4, k), rate / draws) for k in range(1, draws + 1))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    again = mixing.mix(docs, weights, total=100 * 150.0).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in again) == sorted((r["doc_id"], r["copy"]) for r in rows)


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_mixing_refuses_bad_weights(spark, bad):
    weights = spark.createDataFrame([("s0", 1.0), ("s1", bad)], "source string, weight double")
    with pytest.raises(ValueError):
        mixing.rates(odd(spark), weights)


def test_mixing_odd_rows(spark):
    rows = mixing.mix(odd(spark), total=10.0 * len(ODD)).collect()
    assert {r["source"] for r in rows} == {None, "s0", "s1"} and sum(r["doc_id"] == 4 for r in rows) % 2 == 0
    assert mixing.mix(odd(spark, [])).count() == 0


def test_mixing_is_shuffled_and_native(spark):
    out = mixing.mix(documents(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    ids = [r["doc_id"] for r in out.collect()]
    assert ids != sorted(ids)


# -- 5 SimHash


def simple_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def simple_components(ids, prints):
    f = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    group = np.arange(len(ids))
    while True:
        new = np.array([group[near[i]].min() for i in range(len(ids))])
        if (new == group).all():
            break
        group = new
    least = {g: min((ids[i] for i in range(len(ids)) if group[i] == g and ids[i] is not None), default=None) for g in set(group.tolist())}
    return [least[g] for g in group.tolist()]


@pytest.mark.parametrize("shard", [20, 8192])
def test_simhash_components(spark, shard):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    rng = random.Random(2)
    for i in range(150):  # near copies of one text
        w = rows[0][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "word"), (20_003, "word"), (None, "word"), (None, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["fp"] % 2**64): r["component_id"] for r in simhash.near_duplicates(docs, shard=shard).collect()}
    prints = [simple_fingerprint(t) for _, t in rows]
    want = dict(zip(((i, f) for (i, _), f in zip(rows, prints, strict=True)), simple_components([i for i, _ in rows], prints), strict=True))
    assert got == want


def test_links_are_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    ball = base[0] ^ (np.uint64(1) << rng.integers(0, 10, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fp = np.unique(np.concatenate((base, base[:300] ^ np.uint64(5), ball)))
    want = simhash.Forest(len(fp))
    want.link(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2))
    assert (simhash.links_within(fp, fp[:0], 2) == want.root).all()
    tree, whole = simhash.Tree(fp[::3], 9), simhash.Forest(len(fp))
    homes = 0
    for _, home, visit in tree.route(fp, 2):
        at = np.concatenate((home, visit))
        homes += len(home)
        whole.link(at, at[simhash.links_within(fp[home], fp[visit], 2)])
    assert homes == len(fp) and (whole.root == want.root).all()


def test_shards_and_visits_from_small_to_large():
    """Sizes of shards stay as planned while fingerprints grow tenfold, even where they do not cluster at all."""
    rng, said = np.random.default_rng(12), {}
    for n in (200_000, 2_000_000):
        fp = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        shards = simhash.shards_for(len(fp), 8)
        tree = simhash.Tree(np.sort(rng.choice(fp, simhash.SAMPLE, replace=False)), shards)
        parts = [(len(h), len(v)) for at in range(0, len(fp), 1 << 18) for _, h, v in tree.route(fp[at : at + (1 << 18)], 2)]
        home = np.zeros(tree.leaves, int)
        for at in range(0, len(fp), 1 << 18):
            for s, h, _ in tree.route(fp[at : at + (1 << 18)], 2):
                home[s] += len(h)
        said[n] = (shards, int(home.max()), sum(v for _, v in parts) / len(fp))
    print(said)
    for shards, largest, visits in said.values():
        assert largest <= 2.5 * 2_000_000 / shards and largest < 1.5 * simhash.SHARD and visits < 3


@pytest.mark.parametrize("hot", [3, 10**9])
def test_hot_fingerprints_and_hubs_are_broadcast(spark, monkeypatch, hot):
    from branchline.llm import components

    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(components, "HUB", hot)
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else f"some text {i % 5} of words and words {i % 5}") for i in range(60)] + [(100, "one of its own kind")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == dict(zip(texts, simple_components(list(texts), [simple_fingerprint(t) for t in texts.values()]), strict=True))
    star = spark.range(1, 50).selectExpr("id as u", "0L as v").unionAll(spark.range(60, 80).selectExpr("id as u", "59L as v"))
    roots = {r["node"]: r["root"] for r in connected_components(star).collect()}
    assert roots == {**dict.fromkeys(range(50), 0), **dict.fromkeys(range(59, 80), 59)}
    assert len(simhash.keep_one(docs.withColumn("lang", F.lit("en"))).collect()) == len(set(got.values()))


def test_components_of_a_chain(spark):
    links = spark.range(40).selectExpr("id as u", "id + 1 as v").unionAll(spark.createDataFrame([(100, 99), (100, 100), (99, 100)], "u long, v long"))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}
    assert connected_components(links.limit(0)).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    # 9 repeats 1's text; 2 and 3 and the blank 7 and a null id have no words; the null id's own text stays
    assert ids == [-5, 0, 1, 2, 4, 8]
    shuffled = simhash.keep_one(odd(spark), broadcast_ids=0)
    assert sorted(r["doc_id"] or 0 for r in shuffled.collect()) == ids
    assert simhash.keep_one(odd(spark, [])).count() == 0


@pytest.mark.parametrize("few", [simhash.BROADCAST_IDS, 0])
def test_keep_one_of_each_component_with_null_and_repeated_ids(spark, few):
    texts = [f"text number {i} has words {i * 7} of its own {i * 13}" for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, texts[3]), (6, texts[4]), (7, texts[4]), (7, texts[5])]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(odd(spark, rows), broadcast_ids=few).collect())
    assert kept == sorted([("None", texts[0]), ("None", texts[1]), ("5", texts[2]), ("5", texts[3]), ("6", texts[4]), ("7", texts[5])])


# -- 6 personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            else:
                ok = kind == "email" or (kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15)
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(9)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@-+ ()9%é0") for _ in range(rng.randint(0, 36)))
        assert pii.base_spans(t) == base(t), t
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_added_spans():
    model = pii.estimate({pii.code("email", True, (1, 1, 1, 0, 1)): 200, pii.code("phone", True, (1, 1, 1, 0, 1)): 200})

    def added(t):
        return [(pii.KINDS[k], t[a:b]) for k, a, b, strict in pii.chosen([list(s) for s in pii.spans_of(t)], model, {}) if not strict]

    assert added("mail me: john.doe (at) example (dot) com now") == [("email", "john.doe (at) example (dot) com")]
    assert added("call (555) 234-5678 today") == [("phone", "(555) 234-5678")]
    assert added("we met at dot com in 1999, see section 3-4") == []


@pytest.mark.parametrize("written", ["john(AT)example.com", "john {at} example.com", "john ( at ) example.com", "john at example.com", "john [ AT ]example (DOT) com", "john{AT}example{DOT}com"])
def test_every_match_of_the_pattern_is_a_candidate(written):
    text = f"Mail: {written} now"
    assert [(k, text[a:b]) for k, a, b in pii.loose_spans(text, pii.base_spans(text))] == [("email", written)]


def test_loose_spans_of_long_texts():
    rng = random.Random(4)
    pieces = ["a@b.co", "(555) 234-5678", "555-234-5678", "john (at) x.com", "+1 555 234 5678", "123-45-6789", " ", "x", "1234 567890 12345", "4539 5787 6362 1486"]

    def simple(text):
        kept = [(a, b) for _, a, b in pii.base_spans(text)]
        found = [("email", m.start(), m.end()) for m in pii._AT.finditer(text) if re.search(r"dot|\(|\[|\{|\.", m[0], re.I)]
        found += [(k, m.start(), m.end()) for k, p in (("card", pii._LOOSE_CARD), ("phone", pii._LOOSE_PHONE), ("id", pii._LOOSE_ID)) for m in p.finditer(text)]
        out = []
        for k, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
            if not any(a < y and x < b for x, y in kept):
                out.append((k, a, b))
                kept.append((a, b))
        return out

    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.loose_spans(text, pii.base_spans(text)) == simple(text), text
    long = "call (555) 234-5678 or a@b.co, " * 40_000
    assert len(pii.loose_spans(long, pii.base_spans(long))) == 40_000


def test_personal_data_of_odd_rows(spark):
    rows = pii.find_personal(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (2, 3, 7))
    one = next(r for r in rows if r["doc_id"] == 1)
    assert (one["n_email"], one["spans"]) == (1, "email:12:18") and one["base_sha256"] == hashlib.sha256(b"email:12:18").hexdigest()
    assert pii.find_personal(odd(spark, [])).count() == 0


def test_redaction(spark):
    rows = {r["doc_id"]: r for r in pii.redact_documents(odd(spark).where("doc_id is not null")).collect()}
    everything = pii.redact_documents(odd(spark))
    assert everything.columns == odd(spark).columns and sorted(str(r["text"]) for r in everything.where("doc_id is null").collect()) == ["None", "no id here"]
    assert pii.redact_documents(odd(spark, [])).count() == 0
    assert rows[1]["text"] == "hello world <EMAIL>" and rows[1]["n_chars"] == 19 and rows[2]["text"] is None and rows[4]["text"] == LONG and rows[-5]["text"] == "call <PHONE> x"
    assert pii.redact("abcdef", [(0, 1, 4, True), (1, 2, 5, True)]) == "a<EMAIL>f"


# -- 7 pages

PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="menu"><a href=1>Home</a></div>
<div class="content"><h1>Real title</h1><p>First &lt;paragraph&gt; of&nbsp;text.</p><div class="ad">BUY NOW</div><p>Second   part<br>goes on <a href=x>with a link</a>.</p><script>var t="</p>";</script><ul><li>one</li><li>two</li></ul></div>
<div class="sidebar"><p>Popular things that take a lot of room, far more than the article has, to see what happens then.</p></div><form><p>Sign up</p></form><section id="comments"><p>A very long comment that goes on and on and on and on and on and on.</p></section><footer>(c)</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Real title\nFirst <paragraph> of text.\nSecond part goes on with a link.\none\ntwo"
    assert html_text.extract("") == "" and html_text.extract("just text") == "just text" and html_text.extract("<p>a<p>b") == "a\nb"
    assert html_text.extract("<nav>menu<article><p>text &amp; more</article>") == "text & more"
    assert html_text.extract("<nav><a>one</a></nav><footer>c</footer>") == ""
    assert html_text.extract('<div class="site-header"><p>The Daily Site</p></div><div id="body"><div class="post-header"><h1>T</h1></div><p>text of it</p></div>') == "T\ntext of it"
    assert html_text.stretches([0, 5, 0, 5, 0, 0, 0, 4]) == [(1, 4), (7, 8)]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "post-share-enabled", "widget-content", "legal-text", "sidebar"])
def test_containers_named_like_furniture(name):
    text = "<p>First paragraph of the text.</p><p>Second paragraph, a little longer.</p>"
    want = "First paragraph of the text.\nSecond paragraph, a little longer."
    top = '<div class="site-header"><p>The Site</p></div>'
    assert html_text.extract(f'{top}<div class="{name}"><article>{text}<div class="share">Share this</div></article></div>') == want
    assert html_text.extract(f'<main><div class="{name}"><article>{text}</article></div></main>') == want
    assert html_text.extract(f'{top}<div class="{name}">{text}</div>') == want
    # real furniture stays out, however many words or teasers it has
    assert html_text.extract(f'<div>{text}</div><div class="related"><article><p>Read on</p></article></div><section id="comments"><p>{"remark " * 80}</p></section>') == want


def test_whole_articles():
    # blocks of links alone, wherever they are
    links = "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(4))
    page = f"<article><h1><a href=1>Headline</a></h1><p>Some text.</p><ul>{links}</ul><p>More text.</p><p><a href=2>The last word</a></p></article>"
    assert html_text.extract(page) == "Headline\nSome text.\nlink 0\nlink 1\nlink 2\nlink 3\nMore text.\nThe last word"
    # main with a nested article
    assert html_text.extract("<main><h1>Title</h1><p>Intro.</p><article><p>The text of the article.</p></article><p>End.</p></main>") == "Title\nIntro.\nThe text of the article.\nEnd."
    # beyond an advert without an article element
    ad = '<div class="ad">BUY NOW</div>'
    for tag in ("section", "blockquote", "ul"):
        item = "li" if tag == "ul" else "p"
        page = f'<div id="top"><p>Hi</p></div><div class="content"><p>First part of the text, the long one.</p>{ad}<{tag}><{item}>Second part.</{item}></{tag}></div>'
        assert html_text.extract(page).endswith("First part of the text, the long one.\nSecond part."), tag
    page = f'<div class="content"><section><p>First part of the text.</p></section>{ad}<section><p>Short.</p></section></div>'
    assert html_text.extract(page) == "First part of the text.\nShort."
    assert html_text.extract(f'<div><p>Elsewhere.</p></div>{ad}<div class="content"><p>{"The text of it. " * 9}</p></div>') == ("The text of it. " * 9).strip()


def test_names_inside_an_article_and_plain_pages():
    """Four pages that names or missing names used to mislead."""
    text = "<h1><a href=1>Headline</a></h1><p>First paragraph.</p>{}<p>More of it.</p><p><a href=2>The last word</a></p>"
    for inner, said in (('<div class="social-history"><p>How it began.</p></div>', "How it began."), ('<p id="related">What is related.</p>', "What is related."), ('<p class="hidden-gem">A gem.</p>', "A gem.")):
        assert html_text.extract(f"<article>{text.format(inner)}</article>") == f"Headline\nFirst paragraph.\n{said}\nMore of it.\nThe last word"
    assert html_text.extract(f'<article>{text.format("""<div class="ad">BUY NOW</div><div class="comments"><p>I do not agree.</p></div>""")}</article>') == "Headline\nFirst paragraph.\nMore of it.\nThe last word"
    body = [f"Paragraph {i} of a text that has {'very ' * 9}many words, as texts do." for i in range(4)]
    plain = "".join(f"<div>{x}</div>" for x in ["Home About Contact Login", *body[:2], "Said who?", *body[2:], "© 2024 The Site"])
    assert html_text.extract(f"<body>{plain}</body>") == "\n".join([*body[:2], "Said who?", *body[2:]])
    titled = f"<div>Home About Contact Login</div><h1>The title</h1>{''.join(f'<div>{x}</div>' for x in body)}<div>Imprint Privacy Contact</div>"
    assert html_text.extract(titled) == "\n".join(["The title", *body])


def test_surge_and_dive():
    """The windows decide: a light row of lines before and after the text is no stretch."""
    assert html_text.stretches([9, 0, 0, 0, 200, 5, 300, 0, 0, 0, 12, 0]) == [(4, 7)]
    assert html_text.stretches([]) == [] and html_text.stretches([0, 0]) == [] and html_text.stretches([3]) == [(0, 1)]


@pytest.mark.parametrize("tag", ['<div>', '<div class="sidebar">', "<section>", "<article>", "<b>"])
def test_deep_pages_take_linear_memory(tag):
    import tracemalloc

    page = f"{tag}x" * 100_000 + "</p></i>" * 100_000
    tracemalloc.start()
    text = html_text.extract(page)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "x" in text and size < 150 << 20


def test_all_named_like_furniture():
    half = "<p>Some text of some length here.</p>"
    assert html_text.extract(f'<div class="widget">{half}</div><div class="legal">{half}</div>') != ""
    assert html_text.extract('<div class="menu"><a href=1>Home</a></div>') == ""


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract_pages(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html[r["page_id"]], re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\0", article))).split("\0")
        import html as entities

        assert r["text"] == "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x) and r["n_chars"] == len(r["text"])


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (1, "u", "<div>" * 3000 + "deep", "z")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()) == [("", 0), ("a", 1), ("deep", 4)]
    assert html_text.extract_pages(df.limit(0)).count() == 0


# -- 8 toxicity, 9 quality


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(labelled):
    docs, labels = labelled
    return toxicity.fit(docs, labels, fold(labels["doc_id"], 4) == 2)


def accuracy(scored, labels, label, held, threshold):
    rows = scored.join(labels.where(held), "doc_id").select("score", label).collect()
    return sum((r["score"] >= threshold) == bool(r[label]) for r in rows) / len(rows)


def test_toxicity_held_out(labelled, toxic_model):
    docs, labels = labelled
    scored = toxicity.score_documents(docs, toxic_model)
    assert accuracy(scored, labels, "toxic", fold(labels["doc_id"], 4) == 2, toxicity.THRESHOLD) > 0.93


def test_deobfuscation(toxic_model):
    for plain, hidden in (("idiot", "1d1ot"), ("moron", "m0r0n"), ("stupid", "stuuuupid"), ("trash", "tr@sh"), ("clown", "c.l.o.w.n"), ("scum", "$cum")):
        assert plain in toxicity.words_of(hidden, toxic_model.chars) or plain == toxicity.restore(hidden.replace(".", ""), toxic_model.chars), hidden
        if toxic_model.word(plain):
            assert toxic_model.score(f"the {hidden} of that") == pytest.approx(toxic_model.score(f"the {plain} of that"), abs=0.05)
    assert toxic_model.score("you are an i d i o t") == pytest.approx(toxic_model.score("you are an idiot"), abs=1e-6)
    assert toxicity.words_of("plain", toxic_model.chars) == ["plain"]


def test_no_shortcut_past_the_decoder(toxic_model):
    for plain, hidden in (("stupid", "stuupid"), ("idiot", "iidiiot"), ("clown", "cloown")):
        assert plain in toxicity.words_of(hidden, toxic_model.chars), hidden
        assert toxic_model.score(f"the {hidden} of that") == pytest.approx(toxic_model.score(f"the {plain} of that"), abs=1e-6)
    shit = toxicity.CharModel(sum((toxicity.trigrams(w) for w in "shit hits ass as glass".split()), start=type(toxicity.trigrams(""))()))
    assert "shit" in toxicity.words_of("5h17", shit) and "ass" in toxicity.words_of("a55", shit) and "ass" in toxicity.words_of("a$$", shit) and "ass" in toxicity.words_of("@$$!", shit)
    assert toxicity.words_of("1990", shit) == [] and toxicity.words_of("glass", shit)[0] == "glass"
    for plain, hidden in (("moron", "you are a m o r o n"), ("clown", "such a c.l.o.w.n"), ("moron", "y o u  a r e  a  m o r o n"), ("idiot", "you i d i o t I say")):
        assert toxic_model.score(hidden) == pytest.approx(toxic_model.score(f"you are a {plain}"), abs=0.05), hidden
    assert toxic_model.score("A S S E T S and a b c d e f") < toxicity.THRESHOLD


def test_restoration_is_the_best_path():
    """The Viterbi search against all paths."""
    import itertools
    from collections import Counter

    model = toxicity.CharModel(sum((toxicity.trigrams(w) for w in "idiot moron class glass solo total tall ill".split()), Counter()))
    for token in ("1d1ot", "m0oor0n", "cla$$", "t0ta1"):
        best, paths = None, itertools.product(*toxicity._arcs(token))
        for path in paths:
            text, cost = "".join(t for t, _ in path), sum(c for _, c in path)
            w = f"^^{text}$"
            score = cost + sum(model(w[i - 2 : i + 1]) for i in range(2, len(w)))
            if best is None or score > best[0] + 1e-12:
                best = (score, text)
        assert toxicity.restore(token, model) == best[1]


def test_toxicity_odd_rows(spark, toxic_model):
    rows = toxicity.score_documents(odd(spark), toxic_model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.3 for r in rows)
    kept = toxicity.keep_clean(odd(spark), toxic_model)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd(spark), nobody, F.lit(False)).score("anything") < 0.3
    assert toxicity.score_documents(odd(spark, []), toxic_model).count() == 0
    strange = spark.createDataFrame([(1, None, None), (None, 1, 1), (9, 0, 7), (4, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd(spark), strange, F.lit(False)).weights == {}


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 5) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels, F.lit(True)).weights == {}
    assert toxicity.fit(docs, labels, fold(F.col("doc_id"), 4) == 2).word("bad") > 0
    assert fold_of(123, 4) == zlib.crc32(b"123") % 4


def test_characters_are_counted_over_all_texts(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(toxicity, "BLOCK", 20)
    texts = [("bad " if i % 2 else "good ") * 5 for i in range(40)] + ["qvixle qvixle word", "Zorb, once", None, "héllo 1d1ot stuuupid"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    want = sum((toxicity.trigrams(t or "") for t in texts), Counter())
    assert toxicity.fit(docs, labels, fold(F.col("doc_id"), 4) == 2, bound=8).chars.tri == want and want["qvi"] == 2 and want["zor"] == 1


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, fold(labels["doc_id"], 3) == 1)
    assert accuracy(quality.score_documents(docs, model), labels, "quality", fold(labels["doc_id"], 3) == 1, quality.THRESHOLD) > 0.95


def test_quality_odd_rows(spark):
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(odd(spark), nobody, F.lit(False))
    rows = quality.score_documents(odd(spark), model).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    assert all(len(quality.statistics(t or "")) == len(quality.NAMES) and all(map(math.isfinite, quality.statistics(t or ""))) for _, t in ODD)


def test_isotonic():
    knots, values = quality.isotonic(np.array([1.0, 2.0, 3.0, 4.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert knots.tolist() == [1.0, 2.5, 4.0] and values.tolist() == [0.0, 0.5, 1.0]
    _, values = quality.isotonic(np.arange(104.0), np.array([0.0] * 3 + [1.0] * 99 + [0.0, 1.0]))
    assert (np.diff(values) >= 0).all()


@pytest.mark.parametrize("seed", range(20))
def test_isotonic_against_the_minimax_formula(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=rng.integers(1, 60)), int(rng.integers(0, 3)))
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-x))).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    points = np.unique(x)
    for p in points:
        # the greatest, over starts, of the least mean up to an end
        want = max(min(y[(x >= a) & (x <= b)].mean() for b in points[points >= p]) for a in points[points <= p])
        inside = values[np.searchsorted(values, want - 1e-12)]
        assert inside == pytest.approx(want)
    assert (np.diff(np.interp(np.linspace(-4, 4, 200), knots, values)) >= 0).all()


def test_quality_against_dense_equations(labelled):
    """Random features, the ridge regression and the folds, from all rows at once."""
    from branchline.llm.common import bounded_labelled

    docs, labels = labelled
    held = fold(labels["doc_id"], 3) == 1
    model = quality.fit(docs, labels, held, n_features=32)
    part = F.pmod(F.xxhash64(F.lit(quality.SEED), "doc_id"), F.lit(quality.FOLDS)).alias("part")
    rows = bounded_labelled(docs, labels, "quality", held, quality.BOUND).select("text", "label", part).collect()
    x, y, p = np.array([quality.statistics(r["text"]) for r in rows]), np.array([r["label"] for r in rows]), np.array([r["part"] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    np.testing.assert_allclose(model.mean, mean, rtol=1e-9)
    z = np.clip((x - mean) / scale, -8, 8)
    f = np.column_stack((np.ones(len(x)), math.sqrt(2 / 32) * np.cos(z @ model.freq + model.phase)))
    w = np.where(y == 1, 1 / (y == 1).mean(), 1 / (y == 0).mean()) / 2

    def ridge(of):
        root = np.sqrt(w[of])[:, None]
        extra = math.sqrt(quality.RIDGE * len(y) / 32) * np.eye(f.shape[1])
        return np.linalg.lstsq(np.vstack((f[of] * root, extra)), np.concatenate(((2.0 * y[of] - 1) * root[:, 0], np.zeros(len(extra)))), rcond=None)[0]

    np.testing.assert_allclose(model.beta, ridge(np.ones(len(y), bool)), rtol=1e-5, atol=1e-7)
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        raw[p == k] = f[p == k] @ ridge(p != k)
    knots, values = quality.isotonic(raw, y.astype(float))
    np.testing.assert_allclose(model.score(x[:50]), np.interp(f[:50] @ model.beta, knots, values), atol=1e-4)
    # the random features stand for a Gaussian kernel
    many = np.random.default_rng(0).standard_normal((x.shape[1], 20_000)) / quality.WIDTH / math.sqrt(x.shape[1] / 4)
    a, b = z[0], z[1]
    about = 2 * np.mean(np.cos(a @ many + (t := np.random.default_rng(1).uniform(0, 2 * math.pi, 20_000))) * np.cos(b @ many + t))
    assert about == pytest.approx(math.exp(-((a - b) ** 2).sum() / 2 / quality.WIDTH**2 / (x.shape[1] / 4)), abs=0.03)


def test_toxicity_against_simple_counts(labelled):
    """Weights, evidence and scale from plain loops over the learning sample."""
    from collections import Counter

    from branchline.llm.common import bounded_labelled

    docs, labels = labelled
    held = fold(labels["doc_id"], 4) == 2
    model = toxicity.fit(docs, labels, held, bound=200)
    rows = bounded_labelled(docs, labels, "toxic", held, 200).collect()
    chars, counts, n = model.chars, {0: Counter(), 1: Counter()}, Counter(r["label"] for r in rows)
    for r in rows:
        words = {w for t in r["text"].split() for w in toxicity.words_of(t, chars)}
        counts[r["label"]].update({x for w in words for x in ["=" + w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]})
    want = {}
    for x, t in counts[1].items():
        c = counts[0][x]
        odds = math.log((t + 0.5) / (n[1] + 1) / ((c + 0.5) / (n[0] + 1)))
        share = n[1] / (n[0] + n[1])
        gain = t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0)
        if t >= 3 and odds > 2.5 and gain > 10:
            want[x] = min(odds, 9.0)
    assert model.weights == pytest.approx(want) and want

    def evidence(text):
        found = []
        for token in set(text.split()):
            found.append(max((want.get(x, 0.0) for w in toxicity.words_of(token, chars) for x in ["=" + w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]), default=0.0))
        for m in toxicity.SPACED.finditer(text):
            found.append(max((want.get(x, 0.0) for w in toxicity.spaced_words(m[0], chars) for x in ["=" + w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]), default=0.0))
        found = sorted((x for x in found if x > 0), reverse=True) + [0.0] * 3
        return found[0], found[1] + found[2]

    x = np.array([[1.0, *evidence(r["text"])] for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    b = np.array(model.scale)
    p = 1 / (1 + np.exp(-x @ b))
    assert np.abs(x.T @ (y - p) - 1e-2 * b).max() < 1e-3  # no better scale for this evidence
    for r, q in zip(rows, p, strict=True):
        assert model.score(r["text"]) == pytest.approx(q, abs=1e-6)


def test_tokens_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_BYTES", 4000)
    seen, rng, known = toxicity.Seen(), random.Random(3), {}
    for _ in range(300):
        tokens = {f"t{int(rng.expovariate(0.05))}" for _ in range(8)}
        found, new = seen.split(tokens)
        assert sorted(found) == sorted(known[t] for t in tokens - new if known[t])
        for t in new:
            known[t] = rng.choice([0.0, 1.5])
            seen.keep(t, known[t])
        assert len(seen.plain) + len(seen.found) <= 4000 // 2 // toxicity.ENTRY + 8


def test_trigrams_by_code_points():
    from collections import Counter

    def simple(text):
        out = Counter()
        for t in text.lower().split():
            w = t.strip(".,;:!?\"'()*#$%&")
            if re.fullmatch(r"[^\W\d_]+", w) and not re.search(r"(.)\1\1", w):
                w = f"^^{w}$"
                out.update(w[i - 2 : i + 1] for i in range(2, len(w)))
        return out

    rng = random.Random(8)
    alphabet = "aAbBzZéßİΣσς12²½٣ .,!?'\"$#%&*()_-\n\t\x1c中文x́😀" + "".join(chr(0x400 + i) for i in range(130))
    counts, want = toxicity.TrigramCounts(), Counter()
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet if rng.random() < 0.3 else "abAB ") for _ in range(rng.randint(0, 40))) for _ in range(5)]
        counts.add(texts)
        want.update(sum(map(simple, texts), Counter()))
    assert counts.result() == want


# -- where they run

ELSEWHERE = """
import os, sys
from pathlib import Path
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
queries = __spark_entry__.queries()
for name in [q for q in queries if q == "pipeline" or q[2:3].isdigit()]:
    print(name, queries[name](spark, {sf!r}).count(), flush=True)
assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
assert spark.range(5).count() == 5
assert list(Path({shared!r}).glob("branchline*"))
"""


def test_from_another_folder_and_nothing_is_left(tmp_path):
    """All eleven queries where workers can import this package neither from the working folder nor from PYTHONPATH."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root, shared, cwd = str(Path(__file__).resolve().parents[2]), tmp_path / "shared", tmp_path / "cwd"
    shared.mkdir()
    cwd.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=root, shared=str(shared), sf=SF)], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split("\n")) == 12 and not list(shared.glob("branchline*"))


# -- the queries


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs_over_its_table(spark, name):
    table = {"op2": None, "op7": "pages"}.get(name.split("_")[0], "documents")
    rows = QUERIES[name](spark, SF).count()
    if table == "documents" and name.split("_")[0] not in ("op1", "op4"):
        assert rows == documents(spark).count()
    assert rows > 0
