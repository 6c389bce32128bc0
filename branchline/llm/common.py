"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.workspace import file_system, remove_at_exit, shared_root

#: Rows that a function of batches sees at once. Spark bounds the bytes of the batches themselves.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their workers can import it wherever they run.

    The archive lies in the shared folder as long as the driver lives: executors that start late fetch it from there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_branchline_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    sources = sorted((root / "branchline").rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12]
    name = f"branchline-{digest}-{uuid.uuid4().hex[:8]}.zip"
    with tempfile.TemporaryDirectory() as tmp:
        with zipfile.ZipFile(f"{tmp}/{name}", "w", zipfile.ZIP_DEFLATED) as out:
            for p in sources:
                out.write(p, p.relative_to(root).as_posix())
        to = f"{shared_root(spark)}/{name}"
        fs, path = file_system(spark, to)
        fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp}/{name}"), path)
    remove_at_exit(spark, to)
    sc.addPyFile(to)
    sc._branchline_shipped = True


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and losing executors loses nothing.

    What was written lasts until ``discard`` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/branchline-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._branchline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        fs, path = file_system(df.sparkSession, df._branchline_path)
        fs.delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows``, without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one short batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names`` with a beginning that makes them unlike every name in ``taken``, whatever its case."""
    start, have = "_own_", [c.lower() for c in taken]
    while any(c.startswith(start) for c in have):
        start += "_"
    return [start + n for n in names]


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text], F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts


def fold_of(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % parts


def bounded_labelled(docs: DataFrame, labels: DataFrame, label: str, held: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows for learning, as doc_id, text, label.

    ``held`` marks ids that must not be learned from. The rows are those with the smallest hashes of their ids, half of
    the bound for either label (all of a label that has fewer), so the choice does not depend on order or partitions.
    Labels that are null or neither 0 nor 1 are left out; an id with two labels counts once, by its larger label, and an id
    with several texts by the greatest of them, so that no id's rows add up.
    """
    known = (
        labels.where(labels["doc_id"].isNotNull() & labels[label].isin(0, 1) & ~held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    # at most ``bound`` ids, so this side may be broadcast
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("doc_id", "text", "label")
