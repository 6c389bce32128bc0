"""Streams into snapshot tables: every micro-batch is one append, exactly once, and can rebuild what depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..project import Project
from ..sources.snapshots import SnapshotStore

KEY = "branchline.stream"


def append_batch(store: SnapshotStore, table: str, stream: str, df: DataFrame, batch: int) -> bool:
    """Append a micro-batch unless it was appended before; the snapshot's summary remembers the last one of each stream."""
    if not store.exists(table):
        store.seed(table, df.schema)
    found = store.load(table)
    for number in found.ancestors(found.refs["main"].snapshot):
        done = found.snapshots[number].summary.get(f"{KEY}.{stream}")
        if done is not None:
            if int(done) >= batch:
                return False
            break
    store.append(table, df, summary={f"{KEY}.{stream}": str(batch)})
    return True


def ingest(source: DataFrame, project: Project, table: str, stream: str, checkpoint: str, refresh: bool = False, change_set: str = "main", **trigger) -> StreamingQuery:
    """Start the stream. ``refresh`` builds the models that depend on new rows after each batch, on ``change_set``."""

    def each(df: DataFrame, batch: int) -> None:
        if append_batch(project.store, project.table(table), stream, df, batch) and refresh:
            project.run(refresh=True, change_set=change_set)

    writer = source.writeStream.queryName(stream).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(**trigger) if trigger else writer).start()


