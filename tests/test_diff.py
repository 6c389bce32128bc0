import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from branchline.errors import ConfigError, MissingKey
from branchline.operators import diff
from branchline.operators.diff import changed_once, counts, diff_counts, diff_hash, diff_rows, diff_tables, jsonable, resolve_keys, schema_delta


def frame(spark, rows, schema="id long, v string"):
    return spark.createDataFrame(rows, schema)


def test_keyed(spark):
    d = diff_tables("t", frame(spark, [(1, "a"), (2, "b"), (3, "c")]), frame(spark, [(2, "B"), (3, "c"), (4, "d")]), ["id"], 10)
    assert (d.added, d.removed, d.changed, d.unchanged) == (1, 1, 1, 1)
    assert d.samples["changed"] == [{"id": 2, "v": "B"}] and d.samples["removed"] == [{"id": 1, "v": "a"}]


def test_hash(spark):
    d = diff_tables("t", frame(spark, [(1, "a")]), frame(spark, [(1, "a"), (2, "b")]), None, 10)
    assert (d.added, d.removed) == (1, 0) and d.warning


def test_hash_tells_apart_what_text_alone_would_not(spark):
    a, b = frame(spark, [("a", "bc"), (None, "x")], "p string, q string"), frame(spark, [("ab", "c"), ("-", "x")], "p string, q string")
    assert diff_hash(a, b).count() == 4


def test_hash_with_separators_and_clashing_names(spark):
    a, b = frame(spark, [("a\x1f+b", "c"), ("1:a", "")], "p string, q string"), frame(spark, [("a", "b\x1f+c"), ("1:a0:", None)], "p string, q string")
    assert diff_hash(a, b).count() == 4
    schema = "id long, _row_hash string, _diff_hash int, _DIFF_n int, _n int"
    a, b = frame(spark, [(1, "x", 1, 1, 1), (2, "y", 2, 2, 2)], schema), frame(spark, [(1, "z", 1, 1, 1), (2, "y", 2, 2, 2), (2, "y", 2, 2, 2)], schema)
    rows = {r["change_type"]: r.asDict() for r in diff_hash(a, b).collect()}
    assert rows == {"added": {"change_type": "added", "id": 1, "_row_hash": "z", "_diff_hash": 1, "_DIFF_n": 1, "_n": 1}, "removed": {"change_type": "removed", "id": 1, "_row_hash": "x", "_diff_hash": 1, "_DIFF_n": 1, "_n": 1}}
    assert sorted((r["id"], r["_row_hash"]) for r in diff_hash(a, b, ("added",), multiset=True).collect()) == [(1, "z"), (2, "y")]


def test_counts_tell_nested_nulls_and_types_apart(spark):
    schema = "id long, p string, q string, a array<string>, s struct<x:string,y:string>, m map<string,string>, b binary"
    same = (0, None, "x", ["x"], ("x", None), {"k": None}, b"\xff")
    others = [(1, "x", None), (2, None, None, [None, "x"]), (3, None, None, ["x"], (None, "x")), (4, None, None, None, None, {"k": "v"}), (5, None, None, None, None, None, b"\xfe")]
    news = [(1, None, "x"), (2, None, None, ["x", None]), (3, None, None, ["x"], ("x", None)), (4, None, None, None, None, {"k": None}), (5, None, None, None, None, None, b"\xfd")]
    wide = lambda rows: frame(spark, [same, *((*r, *[None] * (7 - len(r))) for r in rows)], schema)
    assert diff_counts(wide(others), wide(news), ["id"]).first().asDict() == {"added": 0, "removed": 0, "changed": 5, "unchanged": 1, "repeated": 0}
    assert diff_hash(wide(others), wide(news), ("added",)).count() == 5
    a, b = frame(spark, [(1, 2), (2, 3)], "id int, v int"), frame(spark, [(1, 2.0), (2, 3.5)], "id long, v double")
    assert diff_counts(a, b, ["id"]).first().asDict() == {"added": 0, "removed": 0, "changed": 1, "unchanged": 1, "repeated": 0}


def test_schema(spark):
    a, b = frame(spark, []), frame(spark, [], "id long, v string, extra double")
    assert schema_delta(a.schema, b.schema) == [("extra", "added", None, "double")]


def test_sample_cap_and_counts_only(spark):
    b = frame(spark, [(i, "x") for i in range(50)])
    d = diff_tables("t", frame(spark, []), b, ["id"], 10)
    assert d.added == 50 and [r["id"] for r in d.samples["added"]] == list(range(10))
    assert diff_tables("t", frame(spark, []), b, ["id"], 0).samples == {}
    assert len(diff_tables("t", frame(spark, []), b, ["id"], None).samples["added"]) == 50


def test_keys():
    assert resolve_keys(["m"], {"m": ["a"]}, ["b"], "hash") == ["a"]
    assert resolve_keys(["m"], {}, ["b"], "hash") == ["b"]
    assert resolve_keys(["m"], {}, [], "hash") is None
    with pytest.raises(MissingKey) as e:
        resolve_keys(["m"], {}, [], "error")
    assert e.value.status == 7


def test_no_usable_key(spark):
    with pytest.raises(ConfigError):
        diff_rows(frame(spark, []), frame(spark, []), ["nope"])


def test_maps_and_nested(spark):
    schema = "id long, m map<string,int>, a array<int>"
    a, b = frame(spark, [(1, {"x": 1, "y": 2}, [1])], schema), frame(spark, [(1, {"y": 2, "x": 1}, [1])], schema)
    assert diff_rows(a, b, ["id"]).first()["change_type"] == "unchanged"
    assert diff_hash(a, b).count() == 0


def test_clashing_names(spark):
    a = frame(spark, [(1, 2, 3)], "id long, in_base long, b0 long")
    b = frame(spark, [(1, 2, 4)], "id long, in_base long, b0 long")
    assert diff_rows(a, b, ["id"]).first().asDict() == {"change_type": "changed", "id": 1, "in_base": 2, "b0": 4}


def test_json_values():
    assert jsonable({"b": b"\x01", "d": datetime.date(2020, 1, 2), "n": Decimal("1.50"), "l": [None]}) == {"b": "01", "d": "2020-01-02", "n": "1.50", "l": [None]}


cell = st.one_of(st.none(), st.integers(0, 3))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell), max_size=6), st.lists(st.tuples(cell, cell), max_size=6))
def test_one_pass_equals_four_joins(spark, left, right):
    """Null-safe keys, duplicate keys pair up."""
    schema = "k int, v int"
    got = counts(diff_rows(frame(spark, left, schema), frame(spark, right, schema), ["k"])).first().asDict()
    fast = diff_counts(frame(spark, left, schema), frame(spark, right, schema), ["k"]).first().asDict()
    fast.pop("repeated")
    assert fast == got
    pairs = [(a, b) for b in right for a in left if a[0] == b[0]]
    assert got == {
        "added": sum(all(a[0] != b[0] for a in left) for b in right), "removed": sum(all(a[0] != b[0] for b in right) for a in left),
        "changed": sum(a[1] != b[1] for a, b in pairs), "unchanged": sum(a[1] == b[1] for a, b in pairs),
    }


def test_hot_key_is_counted_not_joined(spark):
    a = spark.range(60_000).selectExpr("0L as k", "id % 7 as v")
    b = spark.range(50_000).selectExpr("0L as k", "id % 5 as v")
    got = diff_counts(a, b, ["k"]).first().asDict()
    same = sum(sum(1 for _ in range(v, 60_000, 7)) * 10_000 for v in range(5))
    assert got == {"added": 0, "removed": 0, "changed": 60_000 * 50_000 - same, "unchanged": same, "repeated": 1}
    assert changed_once(a.limit(100), b.limit(40), ["k"]).count() == 40
    d = diff_tables("t", a.limit(100), b.limit(40), ["k"], 5)
    assert d.warning.startswith("1 keys") and len(d.samples["changed"]) == 5


def rows_of_tasks(spark, group, f):
    """The result of ``f``, and the largest number of rows that a task of its jobs got by a shuffle or held in memory after reading."""
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    track, store, most, held = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0, 0
    for stage in {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        for m in (tasks.apply(k).taskMetrics().get() for k in range(tasks.size())):
            got = m.shuffleReadMetrics().recordsRead()
            most, held = max(most, got), max(held, 0 if got else m.peakExecutionMemory())
    return out, most, held


@pytest.mark.parametrize(("most", "hot"), [(1_000_000, 0), (500, 0), (1_000_000, 90_000), (500, 90_000)])
def test_counts_give_each_task_few_rows(spark, monkeypatch, most, hot):
    """However many partitions the session asks for, however often keys repeat; also in several passes, and for keys with very many rows."""
    for name, value in (("TASK_ROWS", 10_000), ("MOST_ROWS", most), ("BUCKETS", 64)):
        monkeypatch.setattr(diff, name, value, raising=False)
    key = f"case when id < {hot} then null when id < {hot + 20_000} then id div 2 else id end as k"  # some keys twice
    a = spark.range(0, 180_000, 1, 8).selectExpr(key, "id % 3 as v")
    b = spark.range(0, 200_000, 1, 8).where("id % 10 <> 9").selectExpr(key, "case when id % 4 = 0 then -1 else id % 3 end as v")
    got, most_rows, held = rows_of_tasks(spark, f"diff {most} {hot}", lambda: diff_counts(a, b, ["k"]).first().asDict())
    assert most_rows <= 35_000 and held <= 1_000_000
    sides = []
    for side, end in enumerate((180_000, 200_000)):
        rows: dict = {}
        for i in range(end):
            if not side or i % 10 != 9:
                k = None if i < hot else i // 2 if i < hot + 20_000 else i
                of = rows.setdefault(k, {})
                v = -1 if side and i % 4 == 0 else i % 3
                of[v] = of.get(v, 0) + 1
        sides.append(rows)
    x, y = sides
    count = lambda of: sum(of.values())
    same = sum(m * y[k].get(v, 0) for k, of in x.items() if k in y for v, m in of.items())
    assert got == {
        "added": sum(count(of) for k, of in y.items() if k not in x), "removed": sum(count(of) for k, of in x.items() if k not in y),
        "changed": sum(count(of) * count(y[k]) for k, of in x.items() if k in y) - same, "unchanged": same,
        "repeated": sum(k in y and count(of) + count(y[k]) > 2 for k, of in x.items()),
    }


@pytest.mark.parametrize("task", [1, 1_000])
def test_counts_in_passes_keep_equal_keys_together(spark, monkeypatch, task):
    """Texts that a collation holds equal, zeros of either sign, not-a-number and nulls."""
    for name, value in (("TASK_ROWS", task), ("MOST_ROWS", 1), ("BUCKETS", 64)):
        monkeypatch.setattr(diff, name, value, raising=False)
    a, b = (spark.range(300).selectExpr(f"{f}(concat('k', id)) collate UTF8_LCASE as k", f"if(id % 2 = 0, {zero}, if(id % 3 = 0, double('nan'), null)) as x", "1 as v") for f, zero in (("lower", "0.0d"), ("upper", "-0.0d")))
    for keys, unchanged in ((["k"], 300), (["k", "x"], 300), (["x"], 150 * 150 + 50 * 50 + 100 * 100)):
        got = diff_counts(a.select(*keys, "v"), b.select(*keys, "v"), keys).first().asDict()
        assert (got["added"], got["removed"], got["changed"], got["unchanged"]) == (0, 0, 0, unchanged)
