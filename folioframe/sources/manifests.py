"""Numbered manifests in a shared folder: small texts of which each appears whole, or not at all, by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        place = self.path("manifests")
        names = [x.getPath().getName() for x in self.files.listStatus(place)] if self.files.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        source = self.files.open(self.path(f"manifests/{version}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
        finally:
            source.close()

    def commit(self, number: int, content: dict) -> int:
        """Puts the manifest of version number in place; raises Conflict where that version exists."""
        temporary, final = self.path(f"manifests/.{uuid.uuid4().hex}"), self.path(f"manifests/{number}.json")
        out = self.files.create(temporary, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(temporary, final):
            self.files.delete(temporary, False)
            raise Conflict(f"version {number} is there already")
        return number

    def delete(self, version: int) -> None:
        self.files.delete(self.path(f"manifests/{version}.json"), False)
