"""Bundles of tables that change together: versions under a manifest, and readers that stay on one.

Tables are written to new folders first. Then one small file is added to the manifest; it names every table of the new
version, and appears as a whole or not at all. So a reader sees all tables of a version or none, a run that stops
before that leaves the old version as it was, and folders that no version names are never read. One
writer at a time; a writer that finds another version than it began with gives up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version bigint, name string, folder string, schema string, n_tables int"


class Stored(NamedTuple):
    """A table that has been written; the schema also reads a folder without files."""

    folder: str
    schema: str


class StaleVersion(RuntimeError):
    """Another writer has made a version in the meantime."""


@dataclass(frozen=True)
class Bundle:
    spark: SparkSession
    path: str
    #: Folders of versions that were read; versions never change.
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # no version yet
            return self.spark.createDataFrame([], _MANIFEST)

    def versions(self) -> list[int]:
        """All versions whose entries are all there, oldest first."""
        whole = self._manifest().groupBy("version").agg(F.count("*").alias("n"), F.max("n_tables").alias("n_tables")).where("n = greatest(n_tables, 1)")
        return [r.version for r in whole.orderBy("version").collect()]

    def current(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def folders(self, version: int | None = None) -> dict[str, Stored]:
        """Where the tables of a version (the newest) are."""
        at = self.current() if version is None else version
        if at not in self.known:
            found = {r.name: Stored(r.folder, r.schema) for r in self._manifest().where(F.col("version") == at).collect() if r.name}
            if not found:
                return {}
            self.known[at] = found
        return dict(self.known[at])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.open(self.folders(version)[name])

    def open(self, stored: Stored) -> DataFrame:
        return self.spark.read.schema(stored.schema).parquet(stored.folder)

    def pinned(self, version: int | None = None) -> dict[str, DataFrame]:
        """Every table of one version; later versions don't change what these frames read."""
        return {name: self.open(stored) for name, stored in self.folders(version).items()}

    def stage(self, name: str, rows: DataFrame, by: Iterable[str] = ()) -> Stored:
        """Writes a table that no version has yet."""
        folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(folder)
        return Stored(folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))

    def publish(self, changed: dict[str, Stored | None], base: int) -> int:
        """The next version: that of `base` with the tables of `changed` put in; None takes a table out."""
        if self.current() != base:
            raise StaleVersion(f"version {self.current()} is there, not {base}")
        tables = {n: f for n, f in (self.folders(base) | changed).items() if f is not None}
        entries = [(base + 1, n, *stored, len(tables)) for n, stored in sorted(tables.items())] or [(base + 1, None, None, None, 0)]
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return base + 1

    def commit(self, tables: dict[str, DataFrame | None]) -> int:
        """Replaces (or with None removes) tables, all at once."""
        base = self.current()
        return self.publish({n: None if t is None else self.stage(n, t) for n, t in tables.items()}, base)


def replaced(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A child table in which the rows of `parents` are those of `new`; of other parents `new` gives none."""
    listed = parents.select(key).distinct()
    return old.join(listed, key, "left_anti").unionByName(new.join(listed, key, "left_semi").select(*old.columns))


def each_that_fits(items: list, act: Callable[[list], object]) -> dict[object, str]:
    """`act` on all items at once; if that fails, on either half, down to single ones. The items that fail alone, with their errors.

    `items` is one batch of work, bounded by its caller, and `act` does all or nothing.
    """
    if not items:
        return {}
    try:
        act(items)
        return {}
    except Exception as e:  # noqa: BLE001 - whatever it is, the other items go on
        if len(items) == 1:
            return {items[0]: f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"}
    half = len(items) // 2
    return each_that_fits(items[:half], act) | each_that_fits(items[half:], act)
