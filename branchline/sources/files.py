"""The few file operations that table metadata needs, on local paths and on any file system that Hadoop knows."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from ..errors import ConfigError


class LocalFiles:
    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist; False if it does. Readers see the whole text or no file."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".new-")
        try:
            with os.fdopen(fd, "w") as f:
                f.write(text)
            os.link(tmp, path)  # fails if the name exists
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(tmp)

    def read(self, path: str) -> str:
        return Path(path).read_text()

    def list(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of the entries of a folder, by name; none if it does not exist."""
        try:
            with os.scandir(path) as found:
                return sorted((e.name, e.stat().st_size) for e in found)
        except FileNotFoundError:
            return []

    def delete(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)

    def remove(self, path: str) -> None:
        """Delete a file; one that is gone already does not matter."""
        Path(path).unlink(missing_ok=True)


#: File systems whose rename is atomic and fails where the name exists, which commits rely on. Fixed values.
SAFE = frozenset({"hdfs", "viewfs", "abfs", "abfss"})


class HadoopFiles:
    """Through the session's Hadoop configuration; ``create`` writes beside the name and renames, so readers see whole files."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def create(self, path: str, text: str) -> bool:
        folder, _, name = path.rpartition("/")
        beside = self._path(f"{folder}/.new-{uuid.uuid4().hex}-{name}")
        out = self.fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        done = not self.fs.exists(self._path(path)) and self.fs.rename(beside, self._path(path))
        if not done:
            self.fs.delete(beside, False)
        return bool(done)

    def read(self, path: str) -> str:
        with_stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()

    def list(self, path: str) -> list[tuple[str, int]]:
        p = self._path(path)
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), False)


def files_for(spark: SparkSession, root: str) -> tuple[LocalFiles | HadoopFiles, str]:
    """File operations for a root, and the root as they take it."""
    url = urlparse(root)
    if url.scheme in ("", "file"):
        return LocalFiles(), os.path.abspath(url.path)
    if url.scheme not in SAFE:
        raise ConfigError(f"a warehouse on {url.scheme}:// cannot commit safely, as its renames are no atomic step; use {', '.join(sorted(SAFE))}, a local path, or an Iceberg catalog")
    return HadoopFiles(spark, root), root.rstrip("/")
