"""The queries over the engine's operators, and the SQL that states their results.

Every query goes through the engine: tables are registered in a store, models run on branches, and the result is read from
a branch, from main or from the metadata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqlmeta import SqlMeta
from ..operators import diff as diffs
from ..project import Project
from ..sources.snapshots import SnapshotStore
from ..sources.workspace import model_folder, new_warehouse, write_models
from .graph import scope_of
from .promote import drift_of, orphan_pins, promote_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def project(spark: SparkSession, sf_dir: str, models: dict[str, str], inputs: tuple[str, ...]) -> Project:
    """A project over tables of ``sf_dir``, which are registered on main without copying."""
    out = Project(model_folder(models), spark, overrides={"warehouse": {"catalog": {"warehouse": new_warehouse(spark)}}})
    for t in inputs:
        out.store.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return out


def store(spark: SparkSession, sf_dir: str, *inputs: str) -> SnapshotStore:
    out = SnapshotStore(spark, new_warehouse(spark))
    for t in inputs:
        out.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return out


def built(spark: SparkSession, sf_dir: str, models: dict[str, str], inputs: tuple[str, ...], result: str) -> DataFrame:
    """The rows of one model, after a run of all on a branch."""
    p = project(spark, sf_dir, models, inputs)
    p.run(force=True, change_set="work")
    return p.store.read(result, "work")


# -- one table in two versions: main, and a branch with a fixed edit

BASE = "select o_orderkey, o_custkey, o_totalprice from orders"
EDIT = (
    "select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice from orders where o_orderkey % 7 <> 0"
    " union all select o_orderkey + 1000000 as o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 50 = 0"
)
PAIR = f"WITH a AS ({BASE}), b AS ({EDIT}) "
ON = "b.o_orderkey IS NOT DISTINCT FROM a.o_orderkey"
DIFFER = "(b.o_custkey IS DISTINCT FROM a.o_custkey OR b.o_totalprice IS DISTINCT FROM a.o_totalprice)"


def edited(spark: SparkSession, sf_dir: str, base: str = BASE, edit: str = EDIT, table: str = "orders") -> tuple[DataFrame, DataFrame, Project]:
    """(main, branch, project): a model built and promoted, then built again on a branch with other SQL."""
    p = project(spark, sf_dir, {"mart": base}, (table,))
    p.run(force=True, change_set="first")
    p.promote(change_set="first")
    write_models(p.root, {"mart": edit})
    p.run(models="mart", change_set="edit")
    return p.store.read("mart"), p.store.read("mart", "edit"), p


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models over orders, built and promoted; the first is edited, and the rows of the last that change are returned."""
    models = {
        "stg_orders": "-- key: o_orderkey\nselect o_orderkey, o_custkey, o_totalprice, o_orderdate from orders where o_totalprice > 1000",
        "mart_orders": "-- key: o_orderkey\nselect o.o_orderkey, o.o_custkey, round(o.o_totalprice * 1.08, 2) as gross from stg_orders o",
        "report_customers": "-- key: o_custkey\nselect o_custkey, count(*) as n_orders, round(sum(gross), 2) as gross from mart_orders group by o_custkey",
    }
    p = project(spark, sf_dir, models, ("orders",))
    p.run(force=True, change_set="first")
    p.promote(change_set="first")
    write_models(p.root, {"stg_orders": models["stg_orders"].replace("> 1000", "> 20000")})
    p.run(change_set="first")
    return diffs.diff_rows(p.store.read("report_customers"), p.store.read("report_customers", "first"), ["o_custkey"], ("added", "removed", "changed"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def scan_main(spark, sf_dir):
    return store(spark, sf_dir, "orders").read("orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query(EDIT)
def scan_branch(spark, sf_dir):
    return edited(spark, sf_dir)[1]


@query("SELECT n_nationkey, n_name FROM nation")
def scan_pinned_tag(spark, sf_dir):
    s = store(spark, sf_dir, "nation")
    s.pin("nation", "pin", s.head("nation", "main"))
    s.append("nation", s.read("nation").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return s.read("nation", "pin").select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3")
def time_travel_snapshot(spark, sf_dir):
    s = store(spark, sf_dir, "region")
    old = s.overwrite("region", s.read("region").where("r_regionkey < 3"))
    s.overwrite("region", s.read("region").withColumn("r_name", F.lower("r_name")))
    return s.read("region", snapshot=old.id)


@query("SELECT * FROM (VALUES ('in scope', 'branch'), ('pinned', 'tag'), ('not pinned', 'base'), ('no base', 'main')) t(kind, resolved)")
def resolve_order(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select * from region"}, ("region", "nation"))
    s, rows = p.store, []
    first = s.head("region", "main")
    s.pin("region", "branchline_pin__work__region", first)
    s.create_branch("region", "base")
    second = s.append("region", s.read("region"), "base").id
    third = s.append("region", s.read("region"), "main").id
    s.create_branch("region", "work", "main")
    fourth = s.append("region", s.read("region"), "work").id
    names = {first: "tag", second: "base", third: "main", fourth: "branch"}
    r = p._runner(p.graph(), {})
    rows.append(("in scope", names[r.resolve("region", "work", "base", True).id]))
    rows.append(("pinned", names[r.resolve("region", "work", "base", False).id]))
    s.drop_ref("region", "branchline_pin__work__region")
    rows.append(("not pinned", names[r.resolve("region", "work", "base", False).id]))
    rows.append(("no base", names[r.resolve("region", "work", "gone", False).id]))
    return spark.createDataFrame(rows, "kind string, resolved string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE false")
def seed_is_empty(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select o_orderkey, o_custkey from orders"}, ("orders",))
    p.run(force=True, change_set="work")
    return p.store.read("m")


@query("SELECT 'added' AS change_type, o_orderkey, o_custkey, o_totalprice FROM orders")
def empty_base_diff(spark, sf_dir):
    p = project(spark, sf_dir, {"m": BASE}, ("orders",))
    p.run(force=True, change_set="work")
    return diffs.diff_rows(p.store.read("m"), p.store.read("m", "work"), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def overwrite_replaces(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select o_orderkey, o_totalprice from orders"}, ("orders",))
    for _ in range(2):
        p.run(force=True, change_set="work")
    return p.store.read("m", "work")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 5000, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def append_accumulates(spark, sf_dir):
    s = store(spark, sf_dir, "supplier")
    s.overwrite("copy", s.read("supplier").select("s_suppkey", "s_name"))
    s.append("copy", s.read("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey") + 5000, "s_name").toDF("s_suppkey", "s_name"))
    return s.read("copy")


@query("SELECT table_name, records FROM (SELECT 'stg' AS table_name, count(*) AS records FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'agg', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F')")
def rows_written(spark, sf_dir):
    p = project(spark, sf_dir, {"stg": "select * from orders where o_orderstatus = 'F'", "agg": "select o_custkey, count(*) as n from stg group by o_custkey"}, ("orders",))
    p.run(force=True, change_set="work")
    return spark.createDataFrame([(t, p.store.load(t).head("work").records) for t in ("stg", "agg")], "table_name string, records long")


# -- SQL of models

MODEL_SQL = {
    "model_filter": (("orders",), "select o_orderkey, o_totalprice from orders where o_totalprice > 50000 and o_orderstatus = 'F'"),
    "model_cte_chain": (("orders",), "with big as (select * from orders where o_totalprice > 100000), by_cust as (select o_custkey, count(*) as n from big group by o_custkey) select o_custkey, cast(n as bigint) as n from by_cust where n > 1"),
    "model_join_using": (("orders", "customer"), "select o.o_orderkey, c.c_name, c.c_mktsegment from orders o join (select c_custkey as o_custkey, c_name, c_mktsegment from customer) c using (o_custkey)"),
    "model_alias_join": (("orders", "customer", "nation"), "select n.n_name, cast(count(*) as bigint) as n_orders, round(sum(o.o_totalprice), 1) as total from orders as o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by n.n_name"),
    "model_subquery_in": (("orders", "customer"), "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"),
    "model_union_except": (("nation", "supplier", "customer"), "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 9000 union select c_nationkey from customer where c_acctbal > 9990"),
    "model_window_total": (("lineitem",), "select l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_tax, l_discount) as rn from lineitem"),
    "model_filter_clause": (("orders",), "select o_orderpriority, cast(count(*) filter (where o_orderstatus = 'F') as bigint) as n_f, cast(count(*) as bigint) as n from orders group by o_orderpriority"),
    "model_grouping_sets": (("customer",), "select c_mktsegment, c_nationkey, cast(count(*) as bigint) as n from customer group by grouping sets ((c_mktsegment, c_nationkey), (c_mktsegment), ())"),
    "model_null_safe": (("orders",), "select o_orderkey from orders where nullif(o_orderstatus, 'F') is not distinct from null"),
}


def _model_query(name: str, inputs: tuple[str, ...], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return built(spark, sf_dir, {name: sql}, inputs, name)

    QUERIES[name], ORACLES[name] = run, sql


for _name, (_inputs, _sql) in MODEL_SQL.items():
    _model_query(_name, _inputs, _sql)

STG = "select event_id, user_id, lower(event_type) as event_type, cast(value as decimal(12,2)) as amount, cast(ts as timestamp) as event_ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1"
MART = "select event_id, user_id, event_type, cast(round(amount * 1.0825, 2) as decimal(14,2)) as total, date_trunc('day', event_ts) as day from stg_events"
REPORT = "select day, cast(count(*) as bigint) as n, cast(sum(total) as decimal(22,2)) as total from mart_events group by day"
LAKE = {"stg_events": STG, "mart_events": MART, "report_daily": REPORT}


@query(STG)
def model_dedupe_rownum(spark, sf_dir):
    return built(spark, sf_dir, {"stg_events": STG}, ("events",), "stg_events")


@query(f"WITH stg_events AS ({STG}) {MART}")
def model_mart(spark, sf_dir):
    return built(spark, sf_dir, {k: LAKE[k] for k in ("stg_events", "mart_events")}, ("events",), "mart_events")


@query(f"WITH stg_events AS ({STG}), mart_events AS ({MART}) {REPORT}")
def model_report_daily(spark, sf_dir):
    return built(spark, sf_dir, LAKE, ("events",), "report_daily")


@query("SELECT o_orderkey, o_custkey FROM orders")
def model_exclude(spark, sf_dir):
    return built(spark, sf_dir, {"m": "select * exclude (o_totalprice, o_orderdate, o_orderstatus, o_orderpriority) from orders"}, ("orders",), "m")


@query("SELECT r_regionkey, r_name, n.n_name FROM region JOIN nation n ON r_regionkey = n.n_regionkey")
def model_qualified_reference(spark, sf_dir):
    s = {"m": "select region.r_regionkey, region.r_name, n.n_name from raw.region join raw.nation n on region.r_regionkey = n.n_regionkey"}
    p = project(spark, sf_dir, s, ())
    for t in ("region", "nation"):
        p.store.register_parquet(f"raw.{t}", f"{sf_dir}/{t}.parquet")
    p.run(force=True, change_set="work")
    return p.store.read("m", "work")


@query("SELECT c_custkey, upper(c_name) || '!' AS shout FROM customer")
def model_session_function(spark, sf_dir):
    p = Project(model_folder({"m": "select c_custkey, shout(c_name) as shout from customer"}), spark, overrides={"warehouse": {"catalog": {"warehouse": new_warehouse(spark)}}}, on_session=lambda s: s.sql("create temporary function shout(x string) returns string return upper(x) || '!'"))
    p.store.register_parquet("customer", f"{sf_dir}/customer.parquet")
    p.run(force=True, change_set="work")
    return p.store.read("m", "work")


# -- diffs


def _diff_query(kind: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b, _ = edited(spark, sf_dir)
        return diffs.diff_rows(a, b, ["o_orderkey"], (kind,)).drop("change_type")

    QUERIES[f"diff_{kind}"], ORACLES[f"diff_{kind}"] = run, PAIR + sql


_diff_query("added", f"SELECT b.* FROM b ANTI JOIN a ON {ON}")
_diff_query("removed", f"SELECT a.* FROM a ANTI JOIN b ON {ON}")
_diff_query("changed", f"SELECT b.* FROM b JOIN a ON {ON} WHERE {DIFFER}")
_diff_query("unchanged", f"SELECT b.* FROM b JOIN a ON {ON} WHERE NOT {DIFFER}")


def summary_sql(pair: str, on: str, differ: str) -> str:
    return f"""{pair} SELECT (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {on})) AS added, (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {on})) AS removed,
      (SELECT count(*) FROM b JOIN a ON {on} WHERE {differ}) AS changed, (SELECT count(*) FROM b JOIN a ON {on} WHERE NOT {differ}) AS unchanged"""


@query(summary_sql(PAIR, ON, DIFFER))
def diff_summary(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir)
    return diffs.diff_counts(a, b, ["o_orderkey"]).drop("repeated")


TALK = "select conv_id, turn, role, text from conversations"
TALK_EDIT = "select conv_id, turn, case when turn % 3 = 0 then upper(role) else role end as role, text from conversations where conv_id % 5 <> 0 union all select conv_id + 1000000, turn, role, text from conversations where conv_id % 9 = 0"


@query(summary_sql(f"WITH a AS ({TALK}), b AS ({TALK_EDIT})", "b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.turn IS NOT DISTINCT FROM a.turn", "(b.role IS DISTINCT FROM a.role OR b.text IS DISTINCT FROM a.text)"))
def diff_composite_key(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, TALK, TALK_EDIT, "conversations")
    return diffs.diff_counts(a, b, ["conv_id", "turn"]).drop("repeated")


NULLS = "select nullif(c_custkey, 7) as k, c_nationkey as v from customer"
NULLS_EDIT = (
    "select nullif(c_custkey, 7) as k, case when c_custkey % 4 = 0 then null else c_nationkey end as v from customer where c_custkey % 11 <> 5"
    " union all select -1 - c_custkey as k, c_nationkey as v from customer where c_custkey % 10 = 3"
)


@query(summary_sql(f"WITH a AS ({NULLS}), b AS ({NULLS_EDIT})", "b.k IS NOT DISTINCT FROM a.k", "(b.v IS DISTINCT FROM a.v)"))
def diff_null_keys(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, NULLS, NULLS_EDIT, "customer")
    return diffs.diff_counts(a, b, ["k"]).drop("repeated")


LINES = "select l_orderkey, l_linenumber, l_quantity from lineitem"
LINES_EDIT = "select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then l_quantity + 1 else l_quantity end as l_quantity from lineitem where l_orderkey % 7 <> 0"


@query(summary_sql(f"WITH a AS ({LINES}), b AS ({LINES_EDIT})", "b.l_orderkey IS NOT DISTINCT FROM a.l_orderkey AND b.l_linenumber IS NOT DISTINCT FROM a.l_linenumber", "(b.l_quantity IS DISTINCT FROM a.l_quantity)"))
def diff_duplicate_keys(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, LINES, LINES_EDIT, "lineitem")
    return diffs.diff_counts(a, b, ["l_orderkey", "l_linenumber"]).drop("repeated")


@query(f"WITH a AS ({LINES}), b AS ({LINES_EDIT}) SELECT b.l_orderkey, b.l_linenumber, b.l_quantity FROM b JOIN a ON b.l_orderkey IS NOT DISTINCT FROM a.l_orderkey AND b.l_linenumber IS NOT DISTINCT FROM a.l_linenumber WHERE b.l_quantity IS DISTINCT FROM a.l_quantity")
def diff_duplicate_key_rows(spark, sf_dir):
    """Changed rows in pairs, as they fan out."""
    a, b, _ = edited(spark, sf_dir, LINES, LINES_EDIT, "lineitem")
    return diffs.diff_rows(a, b, ["l_orderkey", "l_linenumber"], ("changed",)).drop("change_type")


WIDER = "select o_orderkey, o_totalprice, o_orderstatus as status from orders"


@query(summary_sql(f"WITH a AS ({BASE}), b AS ({WIDER})", ON, "(b.o_totalprice IS DISTINCT FROM a.o_totalprice)"))
def diff_added_column_common_only(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, BASE, WIDER)
    return diffs.diff_counts(a, b, ["o_orderkey"]).drop("repeated")


@query("SELECT * FROM (VALUES ('o_custkey', 'removed', 'bigint', NULL), ('o_totalprice', 'changed', 'double', 'int'), ('status', 'added', NULL, 'string')) t(column_name, status, base_type, branch_type)")
def diff_schema_delta(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, BASE, "select o_orderkey, cast(o_totalprice as int) as o_totalprice, o_orderstatus as status from orders")
    return diffs.schema_delta_df(a, b)


NATIONS = "select n_nationkey, n_name, n_regionkey from nation"
NATIONS_EDIT = "select n_nationkey, case when n_nationkey = 3 then null else n_name end as n_name, n_regionkey from nation where n_nationkey <> 5 union all select n_nationkey + 50, n_name, n_regionkey from nation where n_nationkey < 4"
NATION_HASH = "md5(coalesce(n_nationkey::VARCHAR, '-') || '|' || coalesce('+' || n_name, '-') || '|' || coalesce(n_regionkey::VARCHAR, '-'))"
NATION_PAIR = f"WITH a AS (SELECT *, {NATION_HASH} AS h FROM ({NATIONS})), b AS (SELECT *, {NATION_HASH} AS h FROM ({NATIONS_EDIT})) "


@query(NATION_PAIR + "SELECT b.n_nationkey, b.n_name, b.n_regionkey FROM b WHERE h NOT IN (SELECT h FROM a)")
def diff_hash_added(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, NATIONS, NATIONS_EDIT, "nation")
    return diffs.diff_hash(a, b, ("added",)).drop("change_type")


@query(NATION_PAIR + "SELECT a.n_nationkey, a.n_name, a.n_regionkey FROM a WHERE h NOT IN (SELECT h FROM b)")
def diff_hash_removed(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, NATIONS, NATIONS_EDIT, "nation")
    return diffs.diff_hash(a, b, ("removed",)).drop("change_type")


@query(NATION_PAIR + "SELECT (SELECT count(*) FROM b WHERE h NOT IN (SELECT h FROM a)) AS added, (SELECT count(*) FROM a WHERE h NOT IN (SELECT h FROM b)) AS removed")
def diff_hash_summary(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir, NATIONS, NATIONS_EDIT, "nation")
    return diffs.counts(diffs.diff_hash(a, b), ("added", "removed"))


@query("SELECT n_regionkey, cast(2 AS BIGINT) AS n FROM (SELECT DISTINCT n_regionkey FROM nation)")
def diff_hash_multiset(spark, sf_dir):
    once = "select distinct n_regionkey from nation"
    a, b, _ = edited(spark, sf_dir, once, f"select * from ({once}) union all select * from ({once}) union all select * from ({once})", "nation")
    return diffs.diff_hash(a, b, ("added",), multiset=True).groupBy("n_regionkey").agg(F.count("*").alias("n"))


SPLIT = "select concat(n_name, chr(31), '+b') as p, 'c' as q from nation"
SPLIT_EDIT = "select n_name as p, concat('b', chr(31), '+c') as q from nation"


@query(SPLIT_EDIT)
def diff_hash_separators(spark, sf_dir):
    """Rows that read alike once their columns are joined by a separator are told apart."""
    a, b, _ = edited(spark, sf_dir, SPLIT, SPLIT_EDIT, "nation")
    return diffs.diff_hash(a, b, ("added",)).drop("change_type")


@query("SELECT n_nationkey, 'x' AS _row_hash FROM nation WHERE n_nationkey = 3")
def diff_hash_clash(spark, sf_dir):
    """A column of the name that a helper could have is compared and kept."""
    a, b, _ = edited(spark, sf_dir, "select n_nationkey, n_name as _row_hash from nation", "select n_nationkey, case when n_nationkey = 3 then 'x' else n_name end as _row_hash from nation", "nation")
    return diffs.diff_hash(a, b, ("added",)).drop("change_type")


KEYED = f"-- key: o_orderkey\n{BASE}", f"-- key: o_orderkey\n{EDIT}"
COUNTS_SQL = f"SELECT 'mart' AS table_name, added, removed, changed FROM ({summary_sql(PAIR, ON, DIFFER)})"


@query(COUNTS_SQL)
def diff_dump_summary(spark, sf_dir):
    """The summary that the diff verb writes beside its files."""
    import json
    from pathlib import Path

    p = edited(spark, sf_dir, *KEYED)[2]
    folder = Path(p.diff(change_set="edit", rows=5)["data"]["diff_dir"])
    found = json.loads((folder / "summary.json").read_text())
    return spark.createDataFrame([(t, d["added"], d["removed"], d["changed"]) for t, d in found.items()], "table_name string, added long, removed long, changed long")


@query(PAIR + f"SELECT b.o_orderkey, b.o_totalprice FROM b JOIN a ON {ON} WHERE {DIFFER} ORDER BY b.o_orderkey LIMIT 5")
def diff_samples_as_json(spark, sf_dir):
    """The changed rows that the diff verb shows."""
    import json
    from pathlib import Path

    p = edited(spark, sf_dir, *KEYED)[2]
    folder = Path(p.diff(change_set="edit", rows=5)["data"]["diff_dir"])
    shown = json.loads((folder / "mart.json").read_text())["changed_samples"]
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"]) for r in shown], "o_orderkey long, o_totalprice double")


@query(PAIR + f"SELECT 'added' AS change_type, b.* FROM b ANTI JOIN a ON {ON} UNION ALL SELECT 'removed', a.* FROM a ANTI JOIN b ON {ON} UNION ALL SELECT 'changed', b.* FROM b JOIN a ON {ON} WHERE {DIFFER}")
def diff_full_rows(spark, sf_dir):
    """All differing rows, as the executors have written them."""
    p = edited(spark, sf_dir, *KEYED)[2]
    return spark.read.parquet(p.diff(change_set="edit", full=True, rows=0)["data"]["tables"][0]["full_rows"])


@query("SELECT * FROM (VALUES ('status', 'added'), ('o_custkey', 'removed'), ('o_totalprice', 'changed')) t(column_name, status)")
def diff_schema_only(spark, sf_dir):
    p = edited(spark, sf_dir, BASE, "select o_orderkey, cast(o_totalprice as int) as o_totalprice, o_orderstatus as status from orders")[2]
    found = p.diff(change_set="edit", schema_only=True)["data"]["tables"][0]
    return spark.createDataFrame([(c, s) for s in ("added", "removed", "changed") for c in found[f"schema_{s}"]], "column_name string, status string")


@query(COUNTS_SQL)
def promote_shows_diff(spark, sf_dir):
    """What a promotion would change, before it does."""
    p = edited(spark, sf_dir, *KEYED)[2]
    found = p.promote(dry_run=True, change_set="edit")["data"]["diff"]
    return spark.createDataFrame([(t, d["added"], d["removed"], d["changed"]) for t, d in found.items()], "table_name string, added long, removed long, changed long")


@query(PAIR + f"SELECT b.* FROM b JOIN a ON {ON} WHERE {DIFFER} ORDER BY b.o_orderkey LIMIT 10")
def diff_sample_topk(spark, sf_dir):
    a, b, _ = edited(spark, sf_dir)
    return diffs.sample(diffs.diff_rows(a, b, ["o_orderkey"]), "changed", ["o_orderkey"], 10)


# -- lineage, scope, refs

CHAIN = {
    "stg": "select * from orders", "cust": "select * from customer", "mid": "select s.o_orderkey, s.o_custkey from stg s join cust c on s.o_custkey = c.c_custkey",
    "mart": "with x as (select * from mid) select o_custkey, count(*) as n from x group by o_custkey", "report": "select * from mart where n > (select avg(n) from mart)", "other": "select * from region",
}
EDGE_SQL = "(VALUES ('stg', 'mid'), ('cust', 'mid'), ('mid', 'mart'), ('mart', 'report')) e(parent, child)"


def chain(spark: SparkSession, sf_dir: str) -> Project:
    return project(spark, sf_dir, CHAIN, ("orders", "customer", "region"))


@query("SELECT * FROM (VALUES ('stg', 'mid', 'model'), ('cust', 'mid', 'model'), ('mid', 'mart', 'model'), ('mart', 'report', 'model'), ('orders', 'stg', 'input'), ('customer', 'cust', 'input'), ('region', 'other', 'input')) t(parent, child, kind)")
def lineage_edges(spark, sf_dir):
    return chain(spark, sf_dir).graph().edges(spark)


@query("SELECT * FROM (VALUES ('cust'), ('orders')) t(name)")
def pinned_inputs(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in scope_of(chain(spark, sf_dir).graph(), ["stg"]).pinned], "name string")


@query(f"WITH RECURSIVE d(name) AS (SELECT 'stg' UNION SELECT e.child FROM d JOIN {EDGE_SQL} ON e.parent = d.name) SELECT name FROM d WHERE name <> 'stg'")
def downstream_closure(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in chain(spark, sf_dir).graph().downstream(["stg"])], "name string")


@query(f"SELECT child AS name FROM {EDGE_SQL} WHERE parent = 'stg'")
def closure_depth_1(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in scope_of(chain(spark, sf_dir).graph(), ["stg"], 1).downstream], "name string")


@query("SELECT * FROM (VALUES ('mart'), ('report')) t(name)")
def stale_by_depth(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in scope_of(chain(spark, sf_dir).graph(), ["stg"], 1).beyond_depth], "name string")


@query("SELECT name, level::INTEGER AS level FROM (VALUES ('cust', 0), ('other', 0), ('stg', 0), ('mid', 1), ('mart', 2), ('report', 3)) t(name, level)")
def topological_order(spark, sf_dir):
    g = chain(spark, sf_dir).graph()
    return spark.createDataFrame([(n, i) for i, level in enumerate(g.order(g.models)) for n in level], "name string, level int")


HASH_PAIRS = {
    "comments and space": ("select a from t -- x", "SELECT  a\nFROM t;"), "case of names": ("select A from T", "select a from t"), "literal": ("select 'A' from t", "select 'a' from t"),
    "quoted name": ("select `A` from t", "select `a` from t"), "operator spelling": ("select a <> 1 from t", "select a != 1 from t"), "alias spelling": ("select a x from t", "select a as x from t"), "number": ("select a from t where a > 15", "select a from t where a > 5"),
}


@query("SELECT * FROM (VALUES ('comments and space', true), ('case of names', true), ('literal', false), ('quoted name', false), ('operator spelling', true), ('alias spelling', true), ('number', false)) t(name, same)")
def ast_hash_equivalence(spark, sf_dir):
    meta = SqlMeta(spark)
    return spark.createDataFrame([(k, meta.hash(a) == meta.hash(b)) for k, (a, b) in HASH_PAIRS.items()], "name string, same boolean")


@query("SELECT * FROM (VALUES ('SELEC FRM nope', 6::INTEGER), ('select 1 as a', 0::INTEGER), ('select (1', 6::INTEGER)) t(text, exit_status)")
def parse_errors(spark, sf_dir):
    from ..errors import BranchlineError

    meta, rows = SqlMeta(spark), []
    for text in ("SELEC FRM nope", "select 1 as a", "select (1"):
        try:
            meta.hash(text)
            rows.append((text, 0))
        except BranchlineError as e:
            rows.append((text, int(e.status)))
    return spark.createDataFrame(rows, "text string, exit_status int")


@query("SELECT * FROM (VALUES ('stg'), ('mid'), ('mart')) t(name)")
def refresh_stale_models(spark, sf_dir):
    p = project(spark, sf_dir, {"stg": "select * from nation", "mid": "select * from stg", "mart": "select * from mid", "other": "select * from region"}, ("nation", "region"))
    p.run(force=True, change_set="first")
    p.promote(change_set="first")
    p.store.append("nation", p.store.read("nation"))
    scope = scope_of(p.graph(), p.stale(p.graph()))
    return spark.createDataFrame([(n,) for n in scope.models], "name string")


@query("SELECT * FROM (VALUES ('first run', 'stg', 'ran'), ('first run', 'mart', 'ran'), ('again', 'stg', 'skipped'), ('again', 'mart', 'skipped'), ('edited', 'stg', 'ran'), ('edited', 'mart', 'ran'), ('forced', 'stg', 'ran'), ('forced', 'mart', 'ran')) t(run, model, status)")
def skip_rule_matrix(spark, sf_dir):
    p = project(spark, sf_dir, {"stg": "select * from nation where n_nationkey > 3", "mart": "select * from stg"}, ("nation",))
    rows = []
    for name, options in (("first run", {"models": "stg"}), ("again", {"models": "stg"}), ("edited", {}), ("forced", {"force": True})):
        if name == "edited":
            write_models(p.root, {"stg": "select * from nation where n_nationkey > 4"})
        rows += [(name, r["model"], r["status"]) for r in p.run(change_set="work", **options)["data"]["results"]]
    return spark.createDataFrame(rows, "run string, model string, status string")


def forked(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """region with two snapshots on main after a branch was made, and one on the branch."""
    s = store(spark, sf_dir, "region")
    s.create_branch("region", "ahead")
    s.append("region", s.read("region"), "ahead")
    s.create_branch("region", "apart")
    s.append("region", s.read("region"), "apart")
    s.create_branch("region", "same")
    return s


@query("SELECT * FROM (VALUES ('append', 2::INTEGER), ('register', 1::INTEGER)) t(operation, sequence)")
def snapshot_ancestry(spark, sf_dir):
    s = forked(spark, sf_dir)
    t = s.load("region")
    return spark.createDataFrame([(t.snapshots[n].operation, t.snapshots[n].sequence) for n in t.ancestors(t.refs["ahead"].snapshot)], "operation string, sequence int")


@query("SELECT * FROM (VALUES ('main', 'ahead', true), ('ahead', 'main', false), ('ahead', 'apart', false), ('main', 'same', true), ('main', 'missing', true)) t(onto, source, possible)")
def is_fast_forward_matrix(spark, sf_dir):
    s = forked(spark, sf_dir)
    pairs = [("main", "ahead"), ("ahead", "main"), ("ahead", "apart"), ("main", "same"), ("main", "missing")]
    return spark.createDataFrame([(a, b, s.is_fast_forward("region", a, b)) for a, b in pairs], "onto string, source string, possible boolean")


@query("SELECT * FROM (VALUES ('mart', 'base', false), ('nation', 'pin', true), ('region', 'pin', false)) t(table_name, kind, drifted)")
def drift_report(spark, sf_dir):
    p = project(spark, sf_dir, {"mart": "select n_name, r_name from nation join region on n_regionkey = r_regionkey"}, ("nation", "region"))
    p.run(force=True, change_set="first")
    p.promote(change_set="first")
    p.run(models="mart", change_set="work")
    p.store.append("nation", p.store.read("nation"))
    return spark.createDataFrame([(d.table, d.kind, d.drifted) for d in drift_of(p.store, p.state.find("work"))], "table_name string, kind string, drifted boolean")


@query("SELECT * FROM (VALUES ('nation', 'pin', 3::INTEGER)) t(table_name, kind, exit_status)")
def status_reports_drift(spark, sf_dir):
    from ..errors import DriftError

    p = project(spark, sf_dir, {"mart": "select n_name from nation"}, ("nation",))
    p.run(force=True, change_set="work")
    p.store.append("nation", p.store.read("nation"))
    try:
        p.status("work")
        rows = []
    except DriftError as e:
        rows = [(d["table"], d["kind"], int(e.status)) for d in e.payload["data"]["data"]["drifted"]]
    return spark.createDataFrame(rows, "table_name string, kind string, exit_status int")


@query(EDIT)
def promote_fast_forward(spark, sf_dir):
    p = edited(spark, sf_dir)[2]
    p.promote(ff_only=True, change_set="edit")
    return p.store.read("mart")


@query("SELECT n_nationkey * 2 AS k FROM nation WHERE n_nationkey > 3 UNION ALL SELECT (n_nationkey + 100) * 2 FROM nation")
def promote_after_drift(spark, sf_dir):
    p = project(spark, sf_dir, {"stg": "select * from nation where n_nationkey > 3", "mart": "select n_nationkey * 2 as k from stg"}, ("nation",))
    p.run(force=True, change_set="work")
    p.store.append("nation", p.store.read("nation").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    p.promote(change_set="work")
    return p.store.read("mart")


@query("SELECT * FROM (VALUES ('a', 'promoted (resumed)'), ('b', 'promoted'), ('c', 'skipped'), ('d', 'failed')) t(table_name, status)")
def promote_resume_status(spark, sf_dir):
    s = store(spark, sf_dir)
    rows = spark.createDataFrame([(1,)], "k int")
    for t in ("a", "b", "c", "d"):
        s.overwrite(t, rows)
        if t != "c":
            s.create_branch(t, "work")
            s.append(t, rows, "work")
    s.append("d", rows)
    out = promote_tables(s, ["d", "c", "b", "a"], "work", "main", {"a": "promoted"}, lambda record: None)
    return spark.createDataFrame([(t, r["status"]) for t, r in out.items()], "table_name string, status string")


@query("SELECT 'customer' AS table_name, 'input' AS role, count(*) AS records FROM customer UNION ALL SELECT 'orders', 'input', count(*) FROM orders UNION ALL SELECT 'mart', 'scope', 0")
def estimate_rollup(spark, sf_dir):
    p = project(spark, sf_dir, {"mart": "select * from orders join customer on o_custkey = c_custkey"}, ("orders", "customer"))
    tables = p.estimate(models="mart", change_set="work")["data"]["tables"]
    return spark.createDataFrame([(t["table"], t["role"], t["records"]) for t in tables], "table_name string, role string, records long")


@query("SELECT * FROM (VALUES ('customer', true), ('orders', true), ('mart', false)) t(table_name, has_bytes)")
def estimate_bytes(spark, sf_dir):
    """Bytes of registered inputs are those of their files."""
    p = project(spark, sf_dir, {"mart": "select * from orders join customer on o_custkey = c_custkey"}, ("orders", "customer"))
    found = p.estimate(models="mart", change_set="work")["data"]
    if found["est_bytes_read"] != sum(t["bytes"] for t in found["tables"]):
        raise AssertionError("the sum is not that of the tables")
    return spark.createDataFrame([(t["table"], t["bytes"] > 1000) for t in found["tables"]], "table_name string, has_bytes boolean")


@query("SELECT * FROM (VALUES ('branchline.branch', 'edit'), ('branchline.changeset', 'edit'), ('branchline.model', 'mart')) t(name, value)")
def provenance_of_main_head(spark, sf_dir):
    p = edited(spark, sf_dir)[2]
    p.promote(change_set="edit")
    summary = p.store.load("mart").head("main").summary
    return spark.createDataFrame([(k, summary[k]) for k in ("branchline.branch", "branchline.changeset", "branchline.model")], "name string, value string")


@query("SELECT * FROM (VALUES ('region', 'branchline_pin__gone__region')) t(table_name, tag)")
def orphan_pin_tags(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select * from region"}, ("region",))
    p.run(force=True, change_set="work")
    p.store.pin("region", "branchline_pin__gone__region", p.store.head("region", "main"))
    active = {pin.tag for c in p.state.change_sets() for pin in c.pins.values()}
    return spark.createDataFrame(orphan_pins(p.store, "branchline_pin__", active), "table_name string, tag string")


@query("SELECT * FROM (VALUES ('m', 'main'), ('region', 'main')) t(table_name, ref)")
def gc_expired(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select * from region"}, ("region",))
    p.run(force=True, change_set="work")
    p.gc(before_days=-1)
    return p.store.refs_df().select("table_name", "ref")


@query("SELECT 'work' AS first_name, 'work__' AS second_begins, true AS second_is_free, 8::INTEGER AS hash_digits")
def branch_names(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select * from region"}, ("region",))
    made = p.branch_create("work", change_set="a")["data"]["branch"]
    again = p.branch_create("work", change_set="b")["data"]["branch"]
    digits = len(again) - len(again.rstrip("0123456789abcdef")) if len(again) > 14 else 0
    return spark.createDataFrame([(made, again[:6], again not in p._refs() - {again} and again != made, min(digits, 8))], "first_name string, second_begins string, second_is_free boolean, hash_digits int")


@query("SELECT * FROM (VALUES ('feature_x_1'), ('a_b'), ('unnamed')) t(name)")
def name_sanitization(spark, sf_dir):
    from ..naming import ref_name

    return spark.createDataFrame([(ref_name(n),) for n in ("feature/x-1", " a  b ", "///")], "name string")


@query("SELECT * FROM (VALUES ('key', 'a, b'), ('kind', 'view'), ('model', 'm')) t(name, value)")
def header_fields(spark, sf_dir):
    from .graph import header

    return spark.createDataFrame(list(header("-- Model: m\n\n-- kind: view\n-- key: a, b\n-- a remark\nselect 1 -- late: no").items()), "name string, value string")


@query("SELECT * FROM (VALUES ('configured', 'a'), ('header', 'b'), ('hash', NULL), ('error', 'exit 7')) t(source, key)")
def diff_key_resolution(spark, sf_dir):
    from ..errors import MissingKey

    rows = [("configured", diffs.resolve_keys(["m"], {"m": ["a"]}, ["b"], "hash")[0]), ("header", diffs.resolve_keys(["m"], {}, ["b"], "hash")[0]), ("hash", diffs.resolve_keys(["m"], {}, [], "hash"))]
    try:
        diffs.resolve_keys(["m"], {}, [], "error")
    except MissingKey as e:
        rows.append(("error", f"exit {int(e.status)}"))
    return spark.createDataFrame(rows, "source string, key string")


@query("SELECT * FROM (VALUES ('a.region'), ('b.nation'), ('supplier')) t(table_name)")
def table_listing(spark, sf_dir):
    s = store(spark, sf_dir, "supplier")
    s.register_parquet("a.region", f"{sf_dir}/region.parquet")
    s.register_parquet("b.nation", f"{sf_dir}/nation.parquet")
    return spark.createDataFrame([(t,) for t in s.list_tables()], "table_name string")


@query("SELECT count(*) AS at_pin, count(*) * 2 AS after_moving FROM nation")
def pin_retarget(spark, sf_dir):
    s = store(spark, sf_dir, "nation")
    s.pin("nation", "p", s.head("nation", "main"))
    s.append("nation", s.read("nation"))
    n = s.read("nation", "p").count()
    s.pin("nation", "p", s.head("nation", "main"))
    return s.read("nation", "p").agg(F.lit(n).cast("long").alias("at_pin"), F.count("*").alias("after_moving"))


@query("SELECT * FROM (VALUES ('m', 'main'), ('region', 'main')) t(table_name, ref)")
def branch_discard_refs(spark, sf_dir):
    p = project(spark, sf_dir, {"m": "select * from region"}, ("region",))
    p.run(force=True, change_set="work")
    p.branch_discard("work")
    return p.store.refs_df().select("table_name", "ref")


@query("SELECT * FROM (VALUES ('mart', 'skipped'), ('other', 'ran'), ('stg', 'skipped')) t(model, status)")
def run_of_edited_only(spark, sf_dir):
    """A change-set that has built three models is run again in full after one of them was edited."""
    models = {"stg": "select * from nation", "mart": "select * from stg", "other": "select * from region"}
    p = project(spark, sf_dir, models, ("nation", "region"))
    p.run(models="stg,other", change_set="work")
    write_models(p.root, {"other": "select * from region where r_regionkey > 1"})
    return spark.createDataFrame([(r["model"], r["status"]) for r in p.run(models="stg,other", change_set="work")["data"]["results"]], "model string, status string")


@query("SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 1")
def pinned_run_ignores_new_rows(spark, sf_dir):
    """The branch keeps answering from its pins; main, refreshed, has the new rows."""
    p = project(spark, sf_dir, {"m": "select n_nationkey from nation"}, ("nation",))
    p.run(force=True, change_set="work")
    extra = p.store.read("nation").where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    p.store.append("nation", extra)
    p.run(models="m", change_set="work")
    if p.store.read("m", "work").count() != p.store.read("nation").count() - extra.count():
        raise AssertionError("the pin has moved")
    p.run(refresh=True, change_set="main")
    return p.store.read("m")


@query("SELECT count(*) AS added_since_branch FROM nation")
def diff_against_branch_point(spark, sf_dir):
    """Production moves after the branch was made: the diff against the branch point does not see that."""
    p = project(spark, sf_dir, {"m": "-- key: n_nationkey\nselect * from nation where n_nationkey < 0"}, ("nation",))
    p.run(force=True, change_set="first")
    p.promote(change_set="first")
    write_models(p.root, {"m": "-- key: n_nationkey\nselect * from nation"})
    p.run(change_set="edit", models="m")
    p.store.append("m", p.store.read("nation"))
    found = p.diff(change_set="edit", rows=0)["data"]["tables"][0]
    return spark.createDataFrame([(found["added"],)], "added_since_branch long")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_into_model(spark, sf_dir):
    """Rows arrive as a stream, are appended exactly once, and the model that reads them is refreshed."""
    from ..sources.workspace import shared_root
    from ..streaming.ingest import ingest

    p = project(spark, sf_dir, {"m": "select event_type, count(*) as n from feed group by event_type"}, ())
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    where = f"{shared_root(spark)}/stream-{p.store.root.rsplit('-', 1)[-1]}"
    ingest(source, p, "feed", "feed", where, refresh=True, availableNow=True).awaitTermination()
    return p.store.read("m")
