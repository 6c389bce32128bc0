"""Differences between two versions of a table.

The rows of a keyed diff come from one null-safe full outer join with a mark on either side: added, removed, changed and
unchanged rows out of one shuffle of each side; equal keys that occur more than once pair up with each other, as in the four
separate joins it stands for. Its counts need no join at all: both sides are aggregated together by key, in one shuffle of
keys and hashes into tasks of a bounded number of rows. Without a key, rows are compared by a hash of all columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, MissingKey

KINDS = ("added", "removed", "changed", "unchanged")
#: Rows that the counts give to one task, and at the most, where as many partitions as Spark writes without buffering rows
#: do not suffice.
TASK_ROWS, MOST_ROWS = 250_000, 1_250_000
#: Groups of keys whose rows are counted first, to find keys with too many rows for one task.
BUCKETS = 4096


def schema_delta(base: T.StructType, branch: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(column, status, base type, branch type) of every column that was added, removed or has another type, sorted."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (base, branch))
    status = {c: "added" if c not in a else "removed" if c not in b else "changed" for c in a.keys() | b.keys() if a.get(c) != b.get(c)}
    return [(c, status[c], a.get(c), b.get(c)) for c in sorted(status)]


def schema_delta_df(base: DataFrame, branch: DataFrame) -> DataFrame:
    return base.sparkSession.createDataFrame(schema_delta(base.schema, branch.schema), "column_name string, status string, base_type string, branch_type string")


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Maps have no equality in Spark: they compare as their sorted entries."""
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def _marked(c: Column, kind: T.DataType) -> Column:
    """A value whose hash tells nulls and lengths inside it apart, which Spark's hashes of nested values pass over."""
    if isinstance(kind, T.ArrayType):
        return F.struct(F.size(c), F.transform(c, lambda x: F.struct(x.isNull(), _marked(x, kind.elementType))))
    if isinstance(kind, T.StructType):
        return F.struct(*(F.struct(c[f.name].isNull(), _marked(c[f.name], f.dataType)) for f in kind.fields))
    if isinstance(kind, T.MapType):
        entries = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _marked(F.array_sort(F.map_entries(c)), T.ArrayType(entries))
    return c


def _hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of the columns, equal where all are equal, nulls included."""
    parts = [p for c in columns for p in (F.col(f"`{c}`").isNull(), _marked(F.col(f"`{c}`"), df.schema[c].dataType))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names`` with a beginning that no name in ``taken`` has, whatever its case."""
    start, have = "_diff_", [c.lower() for c in taken]
    while any(c.startswith(start) for c in have):
        start += "_"
    return [start + n for n in names]


def usable_keys(base: DataFrame, branch: DataFrame, keys: list[str]) -> list[str]:
    """The keys that both sides have; an error if none is left."""
    found = [k for k in keys if k in base.columns and k in branch.columns]
    if not found:
        raise ConfigError(f"none of the diff keys {', '.join(keys)} is a column of both versions")
    return found


def diff_rows(base: DataFrame, branch: DataFrame, keys: list[str], keep: tuple[str, ...] = KINDS) -> DataFrame:
    """change_type and the common columns, with the branch's values (the base's for removed rows), of one joined pass."""
    keys = usable_keys(base, branch, keys)
    common = [c for c in branch.columns if c in base.columns]
    rest = [c for c in common if c not in keys]
    # positional names: no column of either side can clash
    b = branch.select(*(F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(common)), F.lit(True).alias("in_branch"))
    a = base.select(*(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(common)), F.lit(True).alias("in_base"))
    at = {c: i for i, c in enumerate(common)}

    def same(c: str) -> Column:
        i = at[c]
        return _comparable(F.col(f"b{i}"), branch.schema[c].dataType).eqNullSafe(_comparable(F.col(f"a{i}"), base.schema[c].dataType))

    differs = reduce(lambda x, y: x | y, (~same(c) for c in rest), F.lit(False))
    # only the sides whose rows are asked for are kept whole
    need_added, need_removed = "added" in keep, "removed" in keep
    both = "changed" in keep or "unchanged" in keep
    condition = reduce(lambda x, y: x & y, map(same, keys))
    if not both and need_added != need_removed:
        left, right = (b, a) if need_added else (a, b)
        kind, prefix = ("added", "b") if need_added else ("removed", "a")
        rows = left.join(right, condition, "left_anti")
        return rows.select(F.lit(kind).alias("change_type"), *(F.col(f"{prefix}{at[c]}").alias(c) for c in common))
    how = {(True, True): "full_outer", (True, False): "left_outer", (False, True): "right_outer", (False, False): "inner"}[need_added, need_removed]
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_branch").isNull(), "removed").when(differs, "changed").otherwise("unchanged")
    rows = b.join(a, condition, how).withColumn("change_type", change)
    values = [F.when(F.col("in_branch"), F.col(f"b{at[c]}")).otherwise(F.col(f"a{at[c]}").cast(branch.schema[c].dataType)).alias(c) for c in common]
    out = rows if set(keep) == set(KINDS) else rows.where(F.col("change_type").isin(*keep))
    return out.select("change_type", *values)


def diff_counts(base: DataFrame, branch: DataFrame, keys: list[str]) -> DataFrame:
    """``count_differences`` as a table of one row."""
    return branch.sparkSession.createDataFrame([count_differences(base, branch, keys)], "added long, removed long, changed long, unchanged long, repeated long")


def count_differences(base: DataFrame, branch: DataFrame, keys: list[str]) -> tuple[int, int, int, int, int]:
    """added, removed, changed, unchanged, repeated (keys that pair up more than once).

    The numbers of the joined rows, without joining. Only the keys and a 128-bit hash of the other common columns move, once:
    equal rows are counted on either side, then the rows of each key. A key that occurs m times on one side and n times on
    the other stands for m times n pairs, of which as many are unchanged as equal rows pair up. The counts are computed at once.

    Tasks that read hold no rows: nothing is combined there, and there are no more partitions than Spark writes one by one.
    How many tasks count, of how many rows, follows from a first job that counts the rows of ``BUCKETS`` groups of keys. Where
    so many partitions are too few, as for more than 250 million rows, part of the groups is read and counted after the other.
    Groups with far more rows than others have a key that would meet in one task: their rows are dealt out whatever their
    key and combined before they meet. Those alone are not read in parts: beyond 50 million of them, tasks grow with their number.
    """
    keys = usable_keys(base, branch, keys)
    rest = [c for c in branch.columns if c in base.columns and c not in keys]
    at_key, at_rest = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(rest))]

    def side(df: DataFrame, in_branch: int) -> DataFrame:
        values = [_comparable(F.col(f"`{c}`"), df.schema[c].dataType).alias(n) for c, n in zip([*keys, *rest], [*at_key, *at_rest], strict=True)]
        return df.select(*values, F.lit(in_branch).cast("long").alias("b"))

    both = side(base, 0).union(side(branch, 1))  # gives both sides the wider type of each column
    h, i = _hashes(both, at_rest)
    rows = both.select(*at_key, h.alias("h"), i.alias("i"), "b")
    # under a collation, equal texts may hash differently
    bucket = F.pmod(F.xxhash64(F.lit(0), *(k for k in at_key if "collate" not in both.schema[k].dataType.simpleString())), F.lit(BUCKETS))
    held = {r["bucket"]: r["count"] for r in both.groupBy(bucket.alias("bucket")).count().collect()}
    hot = [k for k, m in held.items() if m > max(TASK_ROWS, 8 * sum(held.values()) // BUCKETS)]
    many = sum(held[k] for k in hot)
    few = sum(held.values()) - many
    most = int(branch.sparkSession.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))

    def dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
        return df.repartition(max(1, min(most, -(-n // TASK_ROWS))), *by)

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)

    def tally(alike: DataFrame) -> tuple[int, ...]:
        """The five numbers of equal rows: n on both sides, b of them the branch's."""
        n, b = F.col("n"), F.col("b")
        a, same = n - b, F.col("same")
        of_key = alike.groupBy(*at_key).agg(F.sum(n).alias("n"), F.sum(b).alias("b"), F.sum(a * b).alias("same"))
        repeated = F.when((a > 0) & (b > 0) & (n > 2), F.lit(1).cast("long"))
        return tuple(of_key.agg(total(F.when(a == 0, b), "added"), total(F.when(b == 0, a), "removed"), total(a * b - same, "changed"), total(same, "unchanged"), total(repeated, "repeated")).first())

    row = [*at_key, "h", "i"]
    counted = [F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")]
    found = [(0, 0, 0, 0, 0)]
    parts = -(-few // (most * MOST_ROWS))
    for p in range(parts):
        mine = rows.where(~bucket.isin(hot)) if hot else rows
        mine = mine.where(bucket % parts == p) if parts > 1 else mine
        found.append(tally(dealt(mine, few // parts, *at_key).groupBy(*row).agg(*counted)))
    if hot:
        spread = dealt(rows.where(bucket.isin(hot)).withColumn("task", F.spark_partition_id()), many, *row, "task")
        combined = spread.groupBy(*row, "task").agg(*counted)
        found.append(tally(dealt(combined, many, *row).groupBy(*row).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))))
    added, removed, changed, unchanged, repeated = map(sum, zip(*found, strict=True))
    return added, removed, changed, unchanged, repeated


def changed_once(base: DataFrame, branch: DataFrame, keys: list[str]) -> DataFrame:
    """change_type and the branch's rows that differ from a base row of their key, each once however many there are."""
    keys = usable_keys(base, branch, keys)
    common = [c for c in branch.columns if c in base.columns]
    b = branch.select(*(F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(common)))
    a = base.select(*(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(common)))
    same = {c: _comparable(F.col(f"b{i}"), branch.schema[c].dataType).eqNullSafe(_comparable(F.col(f"a{i}"), base.schema[c].dataType)) for i, c in enumerate(common)}
    differs = reduce(lambda x, y: x | y, (~same[c] for c in common if c not in keys), F.lit(False))
    rows = b.join(a, reduce(lambda x, y: x & y, (same[k] for k in keys)) & differs, "left_semi")
    return rows.select(F.lit("changed").alias("change_type"), *(F.col(f"b{i}").alias(c) for i, c in enumerate(common)))


def row_hash(df: DataFrame) -> Column:
    """MD5 of all columns as text in their order, each behind its length, so that no two rows read alike; a null has none."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            text = F.hex(c)
        elif isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)):
            entries = F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c
            text = F.when(c.isNotNull(), F.to_json(F.struct(entries), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}))
        else:
            text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(F.lit(""), *parts))


def diff_hash(base: DataFrame, branch: DataFrame, keep: tuple[str, ...] = ("added", "removed"), multiset: bool = False) -> DataFrame:
    """change_type and the row, for rows whose hash the other side lacks (with ``multiset``: has fewer times).

    Columns of any name are allowed; one named change_type is kept beside the operator's own."""
    own, theirs, n, m, k, i, row = free_names([*base.columns, *branch.columns], "hash", "theirs", "n", "m", "k", "i", "row")
    a, b = base.withColumn(own, row_hash(base)), branch.withColumn(own, row_hash(branch))
    out = None
    for kind, one, other, columns in (("added", b, a, branch.columns), ("removed", a, b, base.columns)):
        if kind not in keep:
            continue
        if multiset:
            had = other.groupBy(F.col(own).alias(theirs)).agg(F.count("*").alias(n))
            counted = one.groupBy(own).agg(F.count("*").alias(m), F.first(F.struct(*(F.col(f"`{c}`") for c in columns))).alias(row))
            more = counted.join(had, F.col(own) == F.col(theirs), "left").withColumn(k, F.col(m) - F.coalesce(F.col(n), F.lit(0))).where(F.col(k) > 0)
            rows = more.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(k)))).select(f"{row}.*")
        else:
            rows = one.join(other.select(F.col(own).alias(theirs)), F.col(own) == F.col(theirs), "left_anti")
        rows = rows.select(F.lit(kind).alias("change_type"), *(F.col(f"`{c}`") for c in columns))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def counts(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row with a count for each kind; combined before the shuffle."""
    return rows.agg(*(F.count(F.when(F.col("change_type") == k, 1)).alias(k) for k in kinds))


def resolve_keys(names: list[str], configured: dict[str, list[str]], inferred: list[str], on_missing: str) -> list[str] | None:
    """Configured keys, else those of the model's header, else None for a hash diff or an error, as configured."""
    for name in names:
        if configured.get(name):
            return list(configured[name])
    if inferred:
        return list(inferred)
    if on_missing == "error":
        raise MissingKey(f"{names[0]}: no diff key")
    return None


def jsonable(value: Any) -> Any:
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    return value


@dataclass
class TableDiff:
    """Counts, samples and the schema delta of one table."""

    table: str
    keys: list[str] | None
    added: int = 0
    removed: int = 0
    changed: int = 0
    unchanged: int = 0
    samples: dict[str, list[dict]] = field(default_factory=dict)
    schema: list[tuple] = field(default_factory=list)
    warning: str | None = None

    def as_dict(self) -> dict:
        by = lambda status: [r for r in self.schema if r[1] == status]
        return {
            "table": self.table, "keys": self.keys, "added": self.added, "removed": self.removed, "changed": self.changed, "unchanged": self.unchanged,
            "added_samples": self.samples.get("added", []), "removed_samples": self.samples.get("removed", []), "changed_samples": self.samples.get("changed", []),
            "schema_added": {c: b for c, _, _, b in by("added")}, "schema_removed": {c: a for c, _, a, _ in by("removed")}, "schema_changed": {c: [a, b] for c, _, a, b in by("changed")},
            "warning": self.warning,
        }


def sample(rows: DataFrame, kind: str, order: list[str], limit: int | None) -> DataFrame:
    """The first rows of a kind by the order columns (all columns that can be sorted if none): the same on every run."""
    rows = rows.where(F.col("change_type") == kind).drop("change_type")
    by = order or [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows = rows.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in by))
    return rows if limit is None else rows.limit(limit)


def samples(rows: DataFrame, order: list[str], limit: int) -> dict[str, list[dict]]:
    """The first ``limit`` rows of every kind, as ``sample`` has them, in one pass: only so many a kind leave each task."""
    rank, = free_names(rows.columns, "rank")
    by = order or [f.name for f in rows.schema.fields if f.name != "change_type" and not isinstance(f.dataType, T.MapType)]
    first = rows.withColumn(rank, F.row_number().over(Window.partitionBy("change_type").orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in by))))
    out: dict[str, list[dict]] = {}
    for r in sorted(first.where(F.col(rank) <= limit).collect(), key=lambda r: r[rank]):
        out.setdefault(r["change_type"], []).append({k: v for k, v in jsonable(r.asDict(recursive=True)).items() if k not in ("change_type", rank)})
    return out


def all_rows(base: DataFrame, branch: DataFrame, keys: list[str] | None) -> DataFrame:
    """change_type and every row that differs; changed rows once each, however often their keys repeat."""
    if keys is None:
        return diff_hash(base, branch)
    added, removed = (diff_rows(base, branch, keys, (k,)) for k in ("added", "removed"))
    return added.unionByName(removed).unionByName(changed_once(base, branch, keys))


def diff_tables(name: str, base: DataFrame, branch: DataFrame, keys: list[str] | None, max_rows: int | None, schema_only: bool = False) -> TableDiff:
    """Counts and samples (``max_rows`` of each kind; None: all, 0: counts only), and the schema delta."""
    out = TableDiff(name, keys, schema=schema_delta(base.schema, branch.schema))
    if schema_only:
        return out
    kinds = ("added", "removed", "changed")
    if keys is None:
        out.warning = "no diff key: rows are compared by a hash of all columns, so a changed row counts as added and removed"
        rows, order = diff_hash(base, branch), []
        out.added, out.removed = counts(rows, ("added", "removed")).first()
    else:
        order = usable_keys(base, branch, keys)
        out.added, out.removed, out.changed, out.unchanged, repeated = count_differences(base, branch, keys)
        if repeated:
            out.warning = f"{repeated} keys occur more than once: each of their rows pairs up with each"
    if max_rows == 0:
        return out
    if max_rows is not None and (keys is None or not repeated):
        some = tuple(k for k in kinds if getattr(out, k))
        if some:
            out.samples = samples(rows if keys is None else diff_rows(base, branch, keys, some), order, max_rows)
        return out
    for kind in kinds:
        if getattr(out, kind):  # a kind without rows needs no job; the others need only their side of the join
            found = rows if keys is None else changed_once(base, branch, keys) if kind == "changed" else diff_rows(base, branch, keys, (kind,))
            out.samples[kind] = [jsonable(r.asDict(recursive=True)) for r in sample(found, kind, order, max_rows).collect()]
    return out
