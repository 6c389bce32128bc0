"""The pipeline stage by stage against brute-force versions of its decisions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from branchline.llm import mixing, pii, toxicity
from branchline.llm.common import fold, materialize
from branchline.llm.queries import vocabulary

from .test_operators import SF, check_packed, poisson, simple_components, simple_fingerprint, u_of


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage and the last one's result, as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, steps):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold(labels["doc_id"], 4) == 2)
    assert sorted(r["doc_id"] for r in steps[1]) == sorted(r["doc_id"] for r in steps[0] if model.score(r["text"]) < toxicity.THRESHOLD)
    assert {r["doc_id"]: r["text"] for r in steps[1]}.items() <= {r["doc_id"]: r["text"] for r in steps[0]}.items()


def test_one_of_each_group_stays(steps):
    ids = [r["doc_id"] for r in steps[1]]
    groups = simple_components(ids, [simple_fingerprint(r["text"]) for r in steps[1]])
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(set(groups))


def test_personal_data_is_replaced(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2]}
    assert len(steps[3]) == len(before)
    changed = 0
    for r in steps[3]:
        base = pii.base_spans(before[r["doc_id"]])
        changed += r["text"] != before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(re.sub("<[A-Z]+>", "\0", r["text"]))
        assert bool(base) <= (r["text"] != before[r["doc_id"]])
    assert changed


def test_mixing_by_counts(spark, steps):
    sizes = {}
    for r in steps[3]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    weights = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    rates = {s: len(steps[3]) * weights[s] / sum(weights.values()) / n for s, n in sizes.items()}
    want = sorted(r["doc_id"] for r in steps[3] for _ in range(poisson(u_of(mixing.SEED, r["doc_id"]), rates[r["source"]])))
    assert sorted(r["doc_id"] for r in steps[4]) == want and math.isclose(sum(rates[s] * n for s, n in sizes.items()), len(steps[3]))


def test_packing_has_every_token(steps):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    assert sum(r["length"] for r in steps[5]) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in steps[4])
    assert check_packed(steps[5], 4096) >= -(-sum(r["length"] for r in steps[5]) // 4096)


def test_run_is_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in steps[5])


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_texts_pass(spark, tmp_path):
    rows = [(i, None if i % 3 else "some text here", "en", "s", None) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
    assert sorted(r["doc_id"] for r in docs.select(F.col("doc_id")).collect()) == [0, 1] and np.isfinite(docs.count())


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own go through all stages unchanged."""
    text = "a plain text with its own words, number {} of them, and {} more to tell it apart"
    rows = [(i, text.format(i * 7, i * 31), "en", f"s{i % 2}", None, 777, i, i, "p") for i in range(30)]
    rows += [rows[3], rows[3], (None, text.format(1, 2), "en", None, None, 777, -1, -1, "p"), (None, None, None, None, None, 777, -2, -2, "p")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, shuffle_key long, _own_copy long, fp string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = docs.columns, {r[6]: r for r in rows}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == names
        found = docs.collect()
        assert all((r["copy"], r["fp"], r["_own_copy"]) == (777, "p", r["shuffle_key"]) and r["doc_id"] == seen[r["shuffle_key"]][0] for r in found)
        if i == 1:
            assert sorted(r["shuffle_key"] for r in found) == sorted(seen)  # one of each text
    n = docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == n
