"""A store of tables as numbered snapshots: written aside and renamed, migrated with the old one kept, opened with checks.

A snapshot is a folder of Parquet tables and a marker with its schema version; readers see whole snapshots only. All goes
through Hadoop's file systems, so the folder may be anywhere that Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]
MARK = "snapshot.json"


class Opened(NamedTuple):
    """problem: None, missing, newer (written by a later version), damaged (unreadable) or inconsistent."""

    problem: str | None
    number: int
    version: int
    tables: Tables


class Snapshots:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._path("/".join([self.root, *map(str, parts)]))

    def numbers(self) -> list[int]:
        """Snapshots that are whole, oldest first."""
        if not self._fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        return sorted(int(n[1:]) for n in names if n[0] == "s" and n[1:].isdigit() and self._fs.exists(self._at(n, MARK)))

    def write(self, tables: Tables, version: int, clean: bool = True) -> int:
        """A new snapshot. Readers don't see it before it is whole: the folder is renamed, with its marker in it."""
        number = max(self.numbers(), default=0) + 1
        self._fs.delete(self._at("new"), True)
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/new/{name}")
        out = self._fs.create(self._at("new", MARK), True)
        out.write(bytearray(json.dumps({"version": version, "clean": clean, "tables": sorted(tables)}).encode()))
        out.close()
        if not self._fs.rename(self._at("new"), self._at(f"s{number}")):
            raise OSError(f"{self.root}/new could not be renamed")
        return number

    def _mark(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/s{number}/{MARK}", wholetext=True).first()[0])

    def open(self, version: int, check: Callable[[Tables], bool] | None = None) -> Opened:
        """The latest snapshot. check runs only where no clean end is marked; a snapshot of a later version isn't read."""
        number = max(self.numbers(), default=0)
        if not number:
            return Opened("missing", 0, 0, {})
        try:
            mark = self._mark(number)
            if mark["version"] > version:
                return Opened("newer", number, mark["version"], {})
            tables = {name: self.spark.read.parquet(f"{self.root}/s{number}/{name}") for name in mark["tables"]}
            if check is not None and not mark["clean"] and not check(tables):
                return Opened("inconsistent", number, mark["version"], tables)
            return Opened(None, number, mark["version"], tables)
        except Exception as e:  # whatever a reader says of a broken file
            return Opened(f"damaged: {type(e).__name__}", number, 0, {})

    def migrate(self, steps: dict[int, Callable[[Tables], Tables]], version: int, check: Callable[[Tables], bool] | None = None) -> Opened:
        """Applies the steps above the latest snapshot's version in order, as one new snapshot; the old one stays as its backup.

        A step that fails, or a result that fails the check, leaves the old snapshot the latest.
        """
        now = self.open(version)
        if now.problem or now.version == version:
            return now
        tables = now.tables
        for n in range(now.version + 1, version + 1):
            if n in steps:
                tables = steps[n](tables)
        if check is not None and not check(tables):
            raise ValueError(f"the tables of version {version} are inconsistent")
        self.write(tables, version)
        return self.open(version)

    def keep(self, last: int = 2) -> None:
        """Removes all but the last snapshots."""
        for number in self.numbers()[:-last]:
            self._fs.delete(self._at(f"s{number}"), True)

    def clear(self, *kept: str) -> Tables:
        """Removes all snapshots for a rebuild, but first writes those tables of the latest that are to stay as a new store's first."""
        numbers = self.numbers()
        if not numbers:
            return {}
        mark = self._mark(numbers[-1])
        left = {name: self.spark.read.parquet(f"{self.root}/s{numbers[-1]}/{name}") for name in kept if name in mark["tables"]}
        new = self.write(left, mark["version"])
        for number in numbers:
            self._fs.delete(self._at(f"s{number}"), True)
        return {name: self.spark.read.parquet(f"{self.root}/s{new}/{name}") for name in left}
