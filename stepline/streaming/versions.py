"""A keyed table that a stream updates, one version per batch, behind a pointer that moves at once.

A version is a folder that no one has read before it is complete; the pointer, a file replaced by
an atomic rename, names the version and the batch it belongs to. A reader follows the pointer and
sees one whole version whatever the writer does; a batch that is run again after its version was
named changes nothing, one that failed before leaves a folder that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"
KEPT = 2  # versions that stay: the current one and the one that a reader may still be in


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema):
        self.spark, self.path, self.keys, self.schema = spark, path, list(keys), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def current(self) -> tuple[int, list[str]]:
        """The batch of the current version and the folders that stay, the current one first; (-1, []) before the first."""
        place = self._place(POINTER)
        fs = place.getFileSystem(self._conf)
        if not fs.exists(place):
            return -1, []
        stream = fs.open(place)
        try:
            batch, *folders = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
        return int(batch), folders

    def _name(self, batch: int, folders: list[str]) -> None:
        draft = self._place(f"_draft-{uuid.uuid4().hex}")
        fs = draft.getFileSystem(self._conf)
        stream = fs.create(draft, True)
        try:
            stream.write(" ".join([str(batch), *folders]).encode())
        finally:
            stream.close()
        kinds = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        kinds[0] = self._hadoop.Options.Rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, self._place(POINTER), kinds)

    def read(self) -> DataFrame:
        """The current version, as one whole; empty before the first."""
        _, folders = self.current()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folders[0]}")

    def update(self, changed: DataFrame, batch: int) -> bool:
        """Rows of ``changed`` replace those with the same keys; False if the batch was already in."""
        known, folders = self.current()
        if batch <= known:
            return False
        new = f"v{batch}-{uuid.uuid4().hex}"
        rest = self.read()
        same = [rest[k].eqNullSafe(changed[k]) for k in self.keys]
        merged = rest.join(changed.select(*self.keys), same, "left_anti").unionByName(changed.select(*rest.columns))
        merged.write.parquet(f"{self.path}/{new}")
        self._name(batch, [new, *folders][:KEPT])
        for old in [new, *folders][KEPT:]:
            place = self._place(old)
            place.getFileSystem(self._conf).delete(place, True)
        return True
