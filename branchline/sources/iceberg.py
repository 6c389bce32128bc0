"""The store's operations on Iceberg tables, for sessions that have its runtime; refs and snapshots are Iceberg's own."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import Catalog
from ..errors import BranchlineError, ConfigError
from .snapshots import MAIN, Ref, Snapshot, Table


class IcebergStore:
    """As SnapshotStore, through SQL and DataFrameWriterV2. Reading is lazy; refs move by Iceberg's procedures."""

    def __init__(self, spark: SparkSession, catalog: Catalog, name: str = "lake"):
        self.spark, self.catalog = spark, name
        self.root = catalog.warehouse
        try:
            spark._jvm.java.lang.Class.forName("org.apache.iceberg.spark.SparkCatalog")
        except Exception as e:
            raise ConfigError("this catalog needs the Iceberg runtime on Spark's class path") from e

    def on(self, session: SparkSession) -> IcebergStore:
        """The same tables, read through another session."""
        other = object.__new__(IcebergStore)
        other.spark, other.catalog, other.root = session, self.catalog, self.root
        return other

    def _id(self, name: str) -> str:
        return f"{self.catalog}.{name}"

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._id(name))

    def list_tables(self) -> list[str]:
        out = []
        for (ns,) in self.spark.sql(f"SHOW NAMESPACES IN {self.catalog}").collect():
            out += [f"{ns}.{r['tableName']}" for r in self.spark.sql(f"SHOW TABLES IN {self.catalog}.{ns}").collect()]
        return sorted(out)

    def load(self, name: str) -> Table:
        if not self.exists(name):
            raise BranchlineError(f"no table {name}")
        snapshots = {}
        rows = self.spark.sql(f"SELECT * FROM {self._id(name)}.snapshots ORDER BY committed_at").collect()
        for i, r in enumerate(rows, 1):
            s = dict(r["summary"] or {})
            snapshots[r["snapshot_id"]] = Snapshot(r["snapshot_id"], r["parent_id"], i, int(r["committed_at"].timestamp() * 1000), r["operation"], "", (name,), int(s.get("total-records", 0)), int(s.get("total-files-size", 0)), s)
        refs = {r["name"]: Ref(r["type"].lower(), r["snapshot_id"]) for r in self.spark.sql(f"SELECT * FROM {self._id(name)}.refs").collect()}
        return Table(name, len(rows), snapshots, refs)

    def head(self, name: str, ref: str) -> int | None:
        found = self.load(name).refs.get(ref) if self.exists(name) else None
        return found.snapshot if found else None

    def read(self, name: str, ref: str | None = None, snapshot: int | None = None) -> DataFrame:
        number = snapshot if snapshot is not None else self.head(name, ref or MAIN)
        if number is None:
            raise BranchlineError(f"{name}: no ref {ref or MAIN}")
        return self.spark.read.option("snapshot-id", number).table(self._id(name))

    def read_snapshot(self, snapshot: Snapshot) -> DataFrame:
        return self.read(snapshot.files[0], snapshot=snapshot.id)

    def seed(self, name: str, schema: T.StructType, summary: dict | None = None) -> Snapshot:
        self._write(self.spark.createDataFrame([], schema), name, {"branchline.seed": "true", **(summary or {})}).using("iceberg").create()
        return self.load(name).head(MAIN)

    def _write(self, df: DataFrame, target: str, summary: dict | None):
        writer = df.writeTo(self._id(target))
        for k, v in (summary or {}).items():
            writer = writer.option(f"snapshot-property.{k}", v)
        return writer

    def overwrite(self, name: str, df: DataFrame, ref: str = MAIN, summary: dict | None = None) -> Snapshot:
        if not self.exists(name):
            self.seed(name, df.schema)
        if ref != MAIN:
            self.create_branch(name, ref)
        self._write(df, name if ref == MAIN else f"{name}.branch_{ref}", summary).overwritePartitions()
        return self.load(name).head(ref)

    def append(self, name: str, df: DataFrame, ref: str = MAIN, summary: dict | None = None) -> Snapshot:
        self._write(df, name if ref == MAIN else f"{name}.branch_{ref}", summary).append()
        return self.load(name).head(ref)

    def create_branch(self, name: str, branch: str, from_ref: str = MAIN) -> None:
        start = self.head(name, from_ref) or self.head(name, MAIN)
        at = f" AS OF VERSION {start}" if start is not None else ""
        self.spark.sql(f"ALTER TABLE {self._id(name)} CREATE BRANCH IF NOT EXISTS `{branch}`{at}")

    def pin(self, name: str, tag: str, snapshot: int) -> None:
        self.spark.sql(f"ALTER TABLE {self._id(name)} CREATE OR REPLACE TAG `{tag}` AS OF VERSION {snapshot}")

    def point(self, name: str, branch: str, snapshot: int) -> None:
        self.spark.sql(f"ALTER TABLE {self._id(name)} CREATE OR REPLACE BRANCH `{branch}` AS OF VERSION {snapshot}")

    def is_fast_forward(self, name: str, onto: str, source: str) -> bool:
        t = self.load(name)
        a, b = t.refs.get(onto), t.refs.get(source)
        return a is None or b is None or a.snapshot in t.ancestors(b.snapshot)

    def fast_forward(self, name: str, onto: str, source: str) -> bool:
        before = self.head(name, onto)
        self.spark.sql(f"CALL {self.catalog}.system.fast_forward('{name}', '{onto}', '{source}')")
        return self.head(name, onto) != before

    def drop_ref(self, name: str, ref: str) -> bool:
        found = self.load(name).refs.get(ref)
        if found:
            self.spark.sql(f"ALTER TABLE {self._id(name)} DROP {found.kind.upper()} `{ref}`")
        return found is not None

    def expire(self, name: str) -> int:
        before = len(self.load(name).snapshots)
        self.spark.sql(f"CALL {self.catalog}.system.expire_snapshots(table => '{name}')")
        return before - len(self.load(name).snapshots)

    def refs_df(self) -> DataFrame:
        rows: Iterable = [(n, ref, r.kind, r.snapshot) for n in self.list_tables() for ref, r in sorted(self.load(n).refs.items())]
        return self.spark.createDataFrame(list(rows), "table_name string, ref string, kind string, snapshot_id long")

    def describe(self, name: str) -> str:
        return json.dumps(self.spark.table(self._id(name)).schema.jsonValue())
