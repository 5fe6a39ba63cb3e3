"""Manifests: which files make up a stored table, index or collection, one small JSON file for each version.

A version is written under another name and renamed last, so readers see the old one whole until then, and a job that fails
before leaves it as it was. Two writers of one version: the second rename finds the name taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    """The folder of a stored table, reached by Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        if not self._fs.exists(self._p(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        """The latest manifest (or that of a version); FileNotFoundError where there is none."""
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise FileNotFoundError(f"no manifest in {self.path}")
        at = f"{self.path}/manifest-{found[-1] if version is None else version:010d}.json"
        stream = self._fs.open(self._p(at))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, manifest: dict) -> int:
        """Writes manifest as the version after the one it was read from (manifest['version'], 0 for the first)."""
        version = manifest.get("version", 0) + 1
        part = self._p(f"{self.path}/_{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        finally:
            out.close()
        final = self._p(f"{self.path}/manifest-{version:010d}.json")
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise RuntimeError(f"another writer has made version {version} of {self.path}")
        return version

    def folder(self, name: str) -> str:
        """A new folder's path below this store."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def remove(self, folder: str) -> None:
        self._fs.delete(self._p(folder), True)


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """A digest of files' names, lengths and times of change: tells whether a table is still the one that was indexed."""
    import hashlib

    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    told = []
    for f in sorted(files):
        s = path(f).getFileSystem(conf).getFileStatus(path(f))
        told.append(f"{f}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()
