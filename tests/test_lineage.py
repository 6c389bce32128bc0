import pytest

from branchline.errors import BranchlineError, LineageError
from branchline.functions.sqlmeta import SqlMeta, canonical_text, spark_dialect
from branchline.plans.graph import Graph, Model, build_graph, header, scope_of, stale


@pytest.fixture(scope="module")
def meta(spark):
    return SqlMeta(spark)


def write(folder, **models):
    for name, sql in models.items():
        (folder / f"{name}.sql").write_text(sql)
    return folder


def test_header():
    assert header("\n-- Key: a, b\n-- kind: view\n-- just words\nselect 1 -- model: no\n") == {"key": "a, b", "kind": "view"}


def test_cosmetic_edits_do_not_matter(meta):
    assert meta.hash("select a from t where x = 'A' -- c") == meta.hash("SELECT a\n/* d */ FROM T\nWHERE X = 'A';")
    assert meta.hash("select 'A' from t") != meta.hash("select 'a' from t")
    assert meta.hash("select `A` from t") != meta.hash("select `a` from t")
    assert canonical_text("SELECT '--x'  -- y") == "select '--x'"


def test_long_plans_are_not_cut(meta):
    cols = ", ".join(f"c{i}" for i in range(60))
    assert meta.hash(f"select {cols}, y from t") != meta.hash(f"select {cols}, z from t")


def test_refs(meta):
    sql = "with a as (select * from raw), b as (select * from a) select (select max(x) from s1) from b join n.t using (k) where exists (select 1 from s2) and k in (select k from s3)"
    assert [r.name for r in meta.refs(sql)] == ["raw", "s1", "n.t", "s2", "s3"]
    assert all(sql[r.start : r.end] == r.name for r in meta.refs(sql))


def test_cte_that_shadows_a_table(meta):
    assert [r.name for r in meta.refs("with t as (select * from t) select * from t")] == ["t"]
    assert [r.name for r in meta.refs("with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from r")] == []


def test_recursion_and_dialect(meta):
    assert spark_dialect("select * exclude (a), 'x * exclude (b)' from t") == "select * EXCEPT (a), 'x * exclude (b)' from t"


def test_errors(meta, tmp_path):
    for sql in ("SELEC FRM nope", "  -- nothing\n"):
        with pytest.raises(LineageError) as e:
            meta.refs(sql)
        assert e.value.status == 6
    with pytest.raises(LineageError):
        build_graph(write(tmp_path, a="-- kind: incremental\nselect 1"), meta)
    (tmp_path / "a.sql").write_text("-- model: b\nselect 1")
    with pytest.raises(LineageError):
        build_graph(write(tmp_path, b="select 2"), meta)


def test_graph(meta, tmp_path):
    g = build_graph(write(tmp_path, stg="select * from raw.events", mart="-- key: a; b\nselect * from stg s join ns.stg t on true", me="select * from me"), meta, "ns")
    assert g.models["mart"].parents == ("stg",) and g.models["mart"].keys == ("a", "b")
    assert g.models["stg"].inputs == ("raw.events",) and g.models["me"].parents == ()


def test_cycle(meta, tmp_path):
    with pytest.raises(LineageError):
        build_graph(write(tmp_path, a="select * from b", b="select * from a"), meta)


def graph(**parents):
    return Graph({n: Model(n, "", None, parents=tuple(p for p in ps if p in parents), inputs=tuple(p for p in ps if p not in parents)) for n, ps in parents.items()})


def test_scope():
    g = graph(stg=["raw"], mid=["stg"], mart=["mid", "dim"], dim=["raw2"], other=["raw"])
    s = scope_of(g, ["stg"])
    assert s.models == ["stg", "mid", "mart"] and s.pinned == ("dim", "raw")
    s = scope_of(g, ["stg"], depth=1)
    assert s.models == ["stg", "mid"] and s.beyond_depth == ("mart",)
    assert scope_of(g, []).models == []
    with pytest.raises(BranchlineError) as e:
        scope_of(g, ["nope"])
    assert e.value.status == 1


def test_stale():
    g = graph(stg=["raw"], mid=["stg"], new=["raw"])
    assert stale(g, {"raw": 5, "stg": 5, "mid": 4}.get) == ["mid", "new"]
