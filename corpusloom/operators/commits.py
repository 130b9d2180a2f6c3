"""A table of partitions in versions: what replaces partitions becomes visible by one rename, or not at all.

    path/data/<folder>/<by>=<value>/...   files that writers have written
    path/versions/<number>.json           for each version the folder that each value lives in

A writer writes a new folder first and then publishes the next version; a version is renamed into place
and never over another (file systems such as HDFS refuse that rename), so of two writers that start from
one version the second tries again on top of the first. Readers read the newest version whole. A failed
write leaves a folder that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tries to publish a version among other writers, and partitions that a task writes side by side instead of sorting its rows.
TRIES, WRITERS = 20, 64


def _name(value: object) -> str:
    """A partition's name in a version; Spark writes null and empty values to one folder."""
    return "" if value is None else str(value)


class Versions:
    """The table at ``path``, whose partitions are the values of column ``by`` (as text in its folders)."""

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._at("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _version(self, number: int) -> dict:
        if not number:
            return {"schema": None, "folders": {}, "notes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{number}.json", wholetext=True).first().value)

    def latest(self) -> int:
        """The newest version's number, 0 before the first."""
        return max(self._numbers(), default=0)

    def _publish(self, number: int, version: dict) -> bool:
        """Whether this is version ``number`` now; another writer may have been first."""
        draft = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        try:
            done = not self._fs.exists(self._at(f"versions/{number}.json")) and self._fs.rename(draft, self._at(f"versions/{number}.json"))
        finally:
            self._fs.delete(draft, False)
        return done

    def notes(self) -> dict[str, int]:
        """What writers have noted with their commits, such as how far they had read."""
        return self._version(self.latest())["notes"]

    def replace(self, rows: DataFrame, values: Iterable[object], notes: dict[str, int] | None = None) -> int:
        """Let ``rows`` be all that the partitions of ``values`` have, in one commit; the new version's number.

        A value without rows ends empty; rows of other values raise before anything is visible. Other
        partitions stay as they are. ``notes`` are kept with the version, beside older ones of other names.
        """
        values = {_name(v) for v in values}
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        self._write(rows, at)
        found = {_name(r[0]) for r in self.spark.read.schema(rows.schema).parquet(at).select(F.col(self.by).cast("string")).distinct().collect()}
        if not found <= values:
            raise ValueError(f"rows of {self.by} that aren't replaced: {sorted(found - values)[:5]}")
        for _ in range(TRIES):
            number = self.latest()
            now = self._version(number)
            if now["schema"] not in (None, rows.schema.json()):
                raise ValueError("the rows have other columns than the table")
            folders = {v: f for v, f in now["folders"].items() if v not in values} | {v: folder for v in found}
            if self._publish(number + 1, {"schema": rows.schema.json(), "folders": folders, "notes": now["notes"] | (notes or {})}):
                return number + 1
        raise RuntimeError(f"no version could be published in {TRIES} tries")

    def _write(self, rows: DataFrame, at: str) -> None:
        """Write rows by partition; each task keeps its partitions' files open, as sorting whole rows takes their size in memory."""
        conf, name = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(name)
        conf.set(name, str(max(int(before), WRITERS)))
        try:
            rows.write.partitionBy(self.by).parquet(at)
        finally:
            conf.set(name, before)

    def read(self, number: int | None = None, values: Iterable[object] | None = None) -> DataFrame:
        """The newest version's rows, an older one's, or those of some partitions."""
        version = self._version(self.latest() if number is None else number)
        if version["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = T.StructType.fromJson(json.loads(version["schema"]))
        wanted = None if values is None else {_name(v) for v in values}
        by_folder: dict[str, list[str]] = {}
        for value, folder in version["folders"].items():
            if wanted is None or value in wanted:
                by_folder.setdefault(folder, []).append(value)
        out = self.spark.createDataFrame([], schema)
        for folder, own in by_folder.items():
            of_folder = self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}")
            out = out.unionByName(of_folder.filter(F.coalesce(F.col(self.by).cast("string"), F.lit("")).isin(own)))
        return out

    def vacuum(self, keep: int = 1) -> None:
        """Delete versions but the last ``keep``, and folders that none of those names; for when no one reads or writes."""
        numbers = self._numbers()
        used = {f for n in numbers[-keep:] for f in self._version(n)["folders"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"versions/{n}.json"), False)
        data = self._at("data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
