"""Tables that change by versions: a manifest names the folders of data that make a version.

A job writes its rows into a new folder and then one small manifest; only with the manifest does the table change, so a
job that is stopped at any step leaves the old version or the new one, never both or neither. Readers take the newest manifest, or
one they name. Manifests are kept in a ring of slots, so there are never many of them. A manifest lists folders per part (days,
levels), however many rows there are. One writer at a time; the batches of a stream are one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRIES = "version bigint, last_batch bigint, schema string, entries array<struct<part:string,folder:string>>"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Version:
    number: int = -1
    #: The last micro-batch that is in it.
    last_batch: int = -1
    schema: str = ""
    #: (part, folder), oldest first.
    entries: tuple[tuple[str, str], ...] = ()


class VersionedTable:
    """Below ``path``: ``manifest/slot=i`` and ``data/<folder>``, with ``dt=<day>`` folders in it where ``by`` names a column."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = None, slots: int = 16) -> None:
        self.spark, self.path, self.by, self.slots = spark, path.rstrip("/"), by, slots

    def versions(self) -> list[Version]:
        """The versions that can still be read, oldest first."""
        try:
            rows = self.spark.read.schema(_ENTRIES).json(f"{self.path}/manifest").drop("slot").collect()  # as many rows as slots
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((Version(r["version"], r["last_batch"], r["schema"], tuple((x["part"], x["folder"]) for x in r["entries"])) for r in rows), key=lambda v: v.number)

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one asked for; before the first there is an empty one."""
        found = [v for v in self.versions() if number is None or v.number == number]
        if number is not None and not found:
            raise ValueError(f"version {number} of {self.path} is not there (any more)")
        return found[-1] if found else Version()

    def add_folder(self, df: DataFrame) -> tuple[str, list[str]]:
        """Write rows into a new folder that no version names yet; its name and the parts in it."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        if self.by is None:
            df.write.parquet(at)
            return folder, [""]
        # Rows of a part go to as many tasks as their measured size asks for.
        df.hint("rebalance", self.by).write.partitionBy(self.by).parquet(at)
        kind = df.schema[self.by].dataType
        parts = self.spark.read.schema(df.schema).parquet(at).select(F.col(self.by).cast(kind).cast("string")).distinct().collect()
        return folder, [NULL_PART if r[0] is None else r[0] for r in parts]

    def commit(self, entries: Iterable[tuple[str, str]], schema: str, base: Version, batch: int = -1) -> Version:
        """Make a version the newest; one file appears, or nothing does."""
        new = Version(base.number + 1, max(batch, base.last_batch), schema, tuple(entries))
        text = json.dumps({"version": new.number, "last_batch": new.last_batch, "schema": new.schema, "entries": [{"part": p, "folder": f} for p, f in new.entries]})
        self.spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{self.path}/manifest/slot={new.number % self.slots}")
        return new

    def read(self, number: int | None = None, part: Callable[[str], bool] | None = None) -> DataFrame:
        """The rows of a version; ``part`` leaves out folders by the name of their part before anything is read."""
        return self.rows(self.version(number), part)

    def rows(self, v: Version, part: Callable[[str], bool] | None = None) -> DataFrame:
        if not v.schema:
            raise ValueError(f"{self.path} has no version")
        entries = [(p, f) for p, f in v.entries if part is None or part(p)]
        if not entries:
            return self.spark.createDataFrame([], v.schema)
        at = [f"{self.path}/data/{f}" + (f"/{self.by}={p}" if self.by else "") for p, f in entries]
        reader = self.spark.read.schema(v.schema)
        if self.by is None:
            return reader.parquet(*at)
        # Folders differ in their base; each is read with its own, so the part is a partition column.
        bases = {}
        for (_, f), a in zip(entries, at):
            bases.setdefault(f, []).append(a)
        out = None
        for f, paths in bases.items():
            df = reader.option("basePath", f"{self.path}/data/{f}").parquet(*paths)
            out = df if out is None else out.unionByName(df)
        return out

    def replace(self, df: DataFrame, gone: Iterable[str] = (), base: Version | None = None) -> Version:
        """The parts of ``df`` take the place of what they were; parts ``gone`` that have no rows in it vanish."""
        base = base or self.version()
        folder, parts = self.add_folder(df)
        drop = {*parts, *gone}
        return self.commit([*(e for e in base.entries if e[0] not in drop), *((p, folder) for p in parts)], ddl(df), base)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the last ``keep`` versions names; readers of older ones lose them."""
        named = {f for v in self.versions()[-keep:] for _, f in v.entries}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = data.getFileSystem(conf)
        if fs.exists(data):
            for s in fs.listStatus(data):
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)


def ddl(df: DataFrame) -> str:
    """The schema as text, nothing required."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class LeveledLog:
    """A log of micro-batches that stays short: ``fan`` folders of a level are merged into one of the next.

    A log of n batches has about fan * log(n) folders, and a row is rewritten as often as there are levels. A batch that
    comes again is left out. Merging happens in the same version as the batch that made it due.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8) -> None:
        self.table, self.merge, self.fan = VersionedTable(spark, path), merge, fan

    def append(self, batch: DataFrame, batch_id: int) -> None:
        base = self.table.version()
        if batch_id <= base.last_batch:
            return
        folder, _ = self.table.add_folder(batch)
        entries, schema = [*base.entries, ("0", folder)], ddl(batch)
        level = 0
        while len(full := [e for e in entries if e[0] == str(level)]) >= self.fan:
            merged = self.merge(self.table.rows(Version(schema=schema, entries=tuple(full))))
            folder, _ = self.table.add_folder(merged.select(*batch.columns))
            level += 1
            entries = [*(e for e in entries if e not in full), (str(level), folder)]
        self.table.commit(entries, schema, base, batch_id)

    def writer(self, prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function."""
        return lambda batch, batch_id: self.append(prepare(batch), batch_id)

    def read(self, number: int | None = None) -> DataFrame:
        """All that is in the log, merged."""
        return self.merge(self.table.read(number))
