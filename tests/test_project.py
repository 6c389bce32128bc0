import io
import json

import pytest

from branchline import cli
from branchline.envelope import event_writer
from branchline.errors import BranchlineError, ConfigError, DriftError, EmptyScope, PromoteBlocked
from branchline.mcp_server import tools
from branchline.plans.state import StateStore

CS = {"change_set": "feature/x"}


def outcome(answer):
    return {r["model"]: r["status"] for r in answer["data"].get("results", [])}


def rows(project, table, ref="main"):
    return sorted(tuple(r) for r in project.store.read(f"analytics.{table}", ref).collect())


def edit(project, sql="select * from raw_events where amount > 5"):
    (project.root / "models/stg_orders.sql").write_text(sql)


def test_run_builds_downstream_and_main_stays_empty(project):
    answer = project.run(models="stg_orders", **CS)
    assert outcome(answer) == dict.fromkeys(["stg_orders", "mart_orders", "report_daily"], "ran")
    assert rows(project, "stg_orders", "feature_x") == [(2, 20.0), (3, 30.0)] and rows(project, "stg_orders") == []


def test_second_run_skips_and_edit_runs(project):
    project.run(models="stg_orders", **CS)
    assert set(outcome(project.run(models="stg_orders", **CS)).values()) == {"skipped"}
    assert project.run(**CS)["data"]["status"].startswith("nothing in scope")
    edit(project)
    assert project.status(**CS)["data"]["data"]["un_run_changes"] == ["stg_orders"]
    assert set(outcome(project.run(**CS)).values()) == {"ran"}
    assert len(rows(project, "mart_orders", "feature_x")) == 3


def test_cosmetic_edit_is_no_edit(project):
    project.run(models="stg_orders", **CS)
    edit(project, "SELECT *   FROM raw_events\n-- why\nWHERE amount > 15")
    assert "results" not in project.run(**CS)["data"]


def test_new_input_rows_without_edit_are_seen_by_refresh_only(project, add_row):
    project.run(models="stg_orders", **CS)
    add_row(4, 40.0)
    # pins hold: the same question has the same answer
    assert set(outcome(project.run(models="stg_orders", **CS)).values()) == {"skipped"}
    assert set(outcome(project.run(refresh=True, **CS)).values()) == {"ran"}
    assert len(rows(project, "mart_orders", "feature_x")) == 3


def test_diff(project):
    edit(project)
    project.run(models="stg_orders", **CS)
    answer = project.diff(tables="mart_orders", **CS)
    t = answer["data"]["tables"][0]
    assert (t["added"], t["removed"], t["added_samples"][0]["amount_doubled"]) == (3, 0, 20.0)
    assert json.loads((project.home / "diffs/feature_x/summary.json").read_text())["analytics.mart_orders"]["added"] == 3
    assert project.diff(schema_only=True, **CS)["data"]["tables"][0]["added"] == 0
    with pytest.raises(ConfigError):
        project.diff(change_set="unknown")


def test_diff_needs_scope(project):
    project.run(**CS)
    with pytest.raises(EmptyScope) as e:
        project.diff(**CS)
    assert e.value.status == 5


def test_diff_against_branch_point_and_main(project, spark):
    project.run(force=True, change_set="main")
    edit(project)
    project.run(models="stg_orders", **CS)
    project.store.overwrite("analytics.mart_orders", spark.createDataFrame([(9, 9.0)], "order_id long, amount_doubled double"))
    at = {a: project.diff(tables="mart_orders", against=a, **CS)["data"]["tables"][0] for a in ("base", "main")}
    assert (at["base"]["added"], at["base"]["removed"]) == (1, 0) and (at["main"]["added"], at["main"]["removed"]) == (3, 1)


def test_drift_status_and_promote(project, add_row):
    edit(project)
    project.run(models="stg_orders", **CS)
    assert project.status(**CS)["ok"]
    add_row(4, 40.0)
    with pytest.raises(DriftError) as e:
        project.status(**CS)
    assert e.value.status == 3 and e.value.payload["data"]["data"]["drifted"]
    with pytest.raises(PromoteBlocked) as e:
        project.promote(ff_only=True, **CS)
    assert e.value.status == 4
    assert project.promote(dry_run=True, **CS)["data"]["would"].startswith("build again")
    answer = project.promote(**CS)
    assert answer["ok"] and answer["data"]["promote_diff"]["analytics.mart_orders"]["added"] == 4
    assert [r[1] for r in rows(project, "mart_orders")] == [20.0, 40.0, 60.0, 80.0] and project.status(**CS)["ok"]


def test_promote_keeps_snapshot_and_provenance(project):
    project.run(models="stg_orders", **CS)
    built = project.store.head("analytics.mart_orders", "feature_x")
    project.promote(**CS)
    head = project.store.load("analytics.mart_orders").head("main")
    assert head.id == built and head.summary["branchline.changeset"] == "feature/x" and head.summary["branchline.model"] == "mart_orders"
    assert {r["status"] for r in project.promote(**CS)["data"]["results"].values()} == {"up-to-date"}


def test_base_drift_can_be_promoted(project, spark):
    project.run(force=True, change_set="main")
    edit(project)
    project.run(models="stg_orders", **CS)
    project.store.overwrite("analytics.stg_orders", spark.createDataFrame([(7, 7.0)], "order_id long, amount double"))
    assert project.promote(**CS)["ok"] and len(rows(project, "stg_orders")) == 3


def test_promotion_resumes(project, monkeypatch):
    project.run(models="stg_orders", **CS)
    real = project.store.fast_forward

    def failing(name, onto, source):
        if "stg" in name:
            raise BranchlineError("catalog is away")
        return real(name, onto, source)

    monkeypatch.setattr(project.store, "fast_forward", failing)
    assert not project.promote(**CS)["ok"]
    with pytest.raises(BranchlineError):
        project.branch_discard("feature_x")
    monkeypatch.undo()
    got = {t: r["status"] for t, r in project.promote(**CS)["data"]["results"].items()}
    assert got == {"analytics.mart_orders": "promoted (resumed)", "analytics.report_daily": "promoted (resumed)", "analytics.stg_orders": "promoted"}


def test_failure_keeps_what_was_built(project):
    (project.root / "models/mart_orders.sql").write_text("select nope from stg_orders")
    with pytest.raises(BranchlineError) as e:
        project.run(models="stg_orders", **CS)
    assert outcome(e.value.payload) == {"stg_orders": "ran", "mart_orders": "error"}
    (project.root / "models/mart_orders.sql").write_text("select order_id from stg_orders")
    assert outcome(project.run(models="stg_orders", **CS))["stg_orders"] == "skipped"


def test_run_on_main_targets_main(project, add_row):
    project.run(force=True, change_set="main")
    assert len(rows(project, "mart_orders")) == 2
    add_row(4, 40.0)
    for expected in ({"ran"}, set()):
        assert set(outcome(project.run(refresh=True, change_set="main")).values()) == expected


def test_branches_and_gc(project):
    project.run(models="stg_orders", **CS)
    assert [b["data_branch"] for b in project.branch_list()["data"]["branches"]] == ["feature_x"]
    assert any(r["ref"] == "branchline_pin__feature_x__raw_events" for r in project.branch_show("feature_x")["data"]["refs"])
    assert project.gc()["data"]["expired_branches"] == []
    assert project.gc(before_days=-1, dry_run=True)["data"]["expired_branches"] == ["feature/x"]
    assert project.branch_discard("feature_x")["data"]["dropped_refs"] == 4
    assert project.state.change_sets() == [] and project.branch_show("feature_x")["data"]["refs"] == []


def test_discard_is_durable(project):
    project.run(models="stg_orders", **CS)
    project.gc(before_days=-1)
    assert StateStore(path=project.home / "state.db").change_sets() == []
    assert {r["ref"] for r in project.store.refs_df().collect()} == {"main"}


def test_name_collision_is_set_apart(project):
    project.run(models="stg_orders", change_set="feature/x")
    project.run(models="stg_orders", change_set="feature-x")
    names = sorted(c.branch for c in project.state.change_sets())
    assert names[0] == "feature_x" and names[1].startswith("feature_x__")


def test_estimate_and_dry_run(project):
    data = project.estimate(models="stg_orders", **CS)["data"]
    assert data["models"] == 3 and data["est_input_rows"] == 3
    assert project.run(models="stg_orders", dry_run=True, **CS)["data"]["preflight"]["order"] == ["stg_orders", "mart_orders", "report_daily"]
    assert project.state.change_sets() == []
    for bad in ({"refresh": True, "models": "stg_orders"}, {"force": True, "dry_run": True}):
        with pytest.raises(ConfigError):
            project.run(**bad, **CS)


def test_events(project):
    out = io.StringIO()
    project.run(models="stg_orders", on_event=event_writer("run", out), **CS)
    events = [json.loads(line) for line in out.getvalue().splitlines()]
    assert len(events) == 6 and {e["event"] for e in events} == {"run.model.begin", "run.model.end"} and events[0]["events"] == "1"


def test_agent_tools(project):
    t = tools(project)
    answer = t["run"](models="stg_orders")
    assert answer["ok"] and answer["branch"]["change_set"].startswith("mcp-")
    assert t["diff"]("nope")["error"]["code"] == "config" and len(t) == 10
    assert t["gc"]()["data"]["dry_run"] and t["branch_create"]("b", change_set="mine")["branch"]["change_set"] == "mine"


def test_cli(project, capsys, monkeypatch):
    monkeypatch.setattr(cli, "Project", lambda root, profile=None: project)
    assert cli.main(["run", "--models", "stg_orders", "--change-set", "c", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["command"] == "run"
    assert cli.main(["diff", "--change-set", "other"]) == 2
    assert cli.main(["status", "--change-set", "c"]) == 0
    assert cli.main(["run", "--models", "nope", "--change-set", "c"]) == 1
    assert cli.main(["branch", "list"]) == 0


def test_cli_init(tmp_path):
    assert cli.main(["init", "--project", str(tmp_path), "--no-git", "--namespace", "n"]) == 0
    assert cli.main(["init", "--project", str(tmp_path)]) == 2
    assert cli.main(["init", "--project", str(tmp_path / "a"), "--catalog", "rest"]) == 2
    (tmp_path / "b").mkdir()
    assert cli.main(["init", "--project", str(tmp_path / "b"), "--catalog", "rest", "--uri", "http://catalog", "--warehouse", "s3://b/w"]) == 0


def test_preflight_is_cut_to_three():
    assert cli.shortened([]) == "none" and cli.shortened(["a", "b", "c"]) == "a, b, c" and cli.shortened(list("abcde")) == "a, b, c and 2 more"


def test_iceberg_settings(tmp_path):
    from branchline import config
    from branchline.session import iceberg_settings, store_settings

    (tmp_path / config.FILE).write_text("warehouse: {catalog: {type: sql, warehouse: 's3://b/w', uri: 'postgresql+psycopg2://h/db', s3.access-key-id: '${K}', client.region: eu}}")
    cfg = config.load(tmp_path, environ={"K": "key"})
    found = iceberg_settings(cfg)
    assert found["spark.sql.catalog.lake.type"] == "jdbc" and found["spark.sql.catalog.lake.uri"] == "jdbc:postgresql://h/db" and "aws-bundle" in found["spark.jars.packages"]
    assert store_settings(cfg) == {"spark.hadoop.fs.s3a.access.key": "key", "spark.hadoop.fs.s3a.endpoint.region": "eu"}
    (tmp_path / config.FILE).write_text("version: 1")
    plain = config.load(tmp_path, environ={})
    assert iceberg_settings(plain) == {} and store_settings(plain) == {}


def test_stream_is_appended_once(project, spark, tmp_path):
    from branchline.streaming.ingest import append_batch, ingest

    source = tmp_path / "in"
    spark.createDataFrame([(10, 100.0)], "order_id long, amount double").write.parquet(str(source))
    stream = spark.readStream.schema("order_id long, amount double").parquet(str(source))
    ingest(stream, project, "raw_events", "s", str(tmp_path / "cp"), refresh=True, availableNow=True).awaitTermination()
    assert len(rows(project, "raw_events")) == 4 and (10, 200.0) in rows(project, "mart_orders")
    again = spark.createDataFrame([(10, 100.0)], "order_id long, amount double")
    assert not append_batch(project.store, "analytics.raw_events", "s", again, 0) and len(rows(project, "raw_events")) == 4
