"""Places for short-lived data: the folder that a cluster shares, warehouses in it, and folders for model files on the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import ConfigError


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, one of our own, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="branchline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have an existing file or folder deleted when the driver ends."""
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)


def new_warehouse(spark: SparkSession) -> str:
    """A new folder below the shared one that lasts as long as the driver."""
    path = f"{shared_root(spark)}/warehouse-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def model_folder(models: dict[str, str], settings: str = "branching: {git_sync: false}\n") -> Path:
    """A project folder with the given models (name to SQL) that is deleted when the process ends."""
    root = Path(tempfile.mkdtemp(prefix="branchline-project-"))
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    (root / "models").mkdir()
    (root / "branchline.yml").write_text(settings)
    write_models(root, models)
    return root


def write_models(root: Path, models: dict[str, str]) -> None:
    for name, sql in models.items():
        (root / "models" / f"{name}.sql").write_text(sql)
