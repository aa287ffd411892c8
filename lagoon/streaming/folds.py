"""A table kept by micro-batches: each writes its own fold, folds of folds keep the number of folders small.

State is never read to take in a batch: a batch is folded by itself (sums, first
or last by arrival, merged spells) and written as a part of level 0. Folding is
associative, so every FAN parts in a row are folded into one of the next level,
much as digits carry; after n batches a reader opens less than
FAN * log(n) / log(FAN) folders. A batch costs what its rows cost, and its share
of the carries, whatever the age of the table; and no row is ever too late.

Replays are safe: part n of each level depends on the batches up to n alone and is
overwritten by the same rows. The parts a carry was made of go when the next batch
begins, that is when the batch that carried can no longer be replayed on its own;
a run from a fresh checkpoint writes all of them anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FAN = 10


@dataclass(frozen=True)
class Fold:
    """ddl: columns of a fold; combine: the fold of rows of several folds, in any order and grouping."""

    ddl: str
    combine: Callable[[DataFrame], DataFrame]


class FoldTable:
    def __init__(self, spark: SparkSession, folder: str, fold: Fold, fan: int = FAN):
        self.spark, self.folder, self.fold, self.fan = spark, folder.rstrip("/"), fold, fan

    def _path(self, level: int, last: int) -> str:
        return f"{self.folder}/level={level}/last={last}"

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str, what: str) -> list[int]:
        p, fs = self._files(path)
        if not fs.exists(p):
            return []
        found = (re.fullmatch(rf"{what}=(\d+)", s.getPath().getName()) for s in fs.listStatus(p))
        return sorted(int(m[1]) for m in found if m)

    def _parts(self) -> set[tuple[int, int]]:
        """(level, last batch) of all parts that are complete."""
        found = set()
        for level in self._names(self.folder, "level"):
            for last in self._names(f"{self.folder}/level={level}", "last"):
                p, fs = self._files(f"{self._path(level, last)}/_SUCCESS")
                if fs.exists(p):
                    found.add((level, last))
        return found

    def covering(self, last: int) -> list[tuple[int, int]]:
        """Fewest parts that hold the batches from 0 to `last`; a batch that was never run has none."""
        there, out, start = self._parts(), [], 0
        while start <= last:
            level = 0
            while start % self.fan ** (level + 1) == 0 and start + self.fan ** (level + 1) <= last + 1:
                level += 1
            while level and (level, start + self.fan**level - 1) not in there:
                level -= 1
            part = (level, start + self.fan**level - 1)
            if part in there:
                out.append(part)
            start += self.fan**level
        return out

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.fold.ddl)
        return self.spark.read.schema(self.fold.ddl).parquet(*[self._path(*p) for p in parts])

    def write(self, rows: DataFrame, n: int) -> None:
        """Take in batch n, and carry."""
        self._expire(n)
        self.fold.combine(rows).write.mode("overwrite").parquet(self._path(0, n))
        level = 1
        while (n + 1) % self.fan**level == 0:
            step, there = self.fan ** (level - 1), self._parts()
            below = [(level - 1, n - k * step) for k in range(self.fan)]
            self.fold.combine(self._read([p for p in below if p in there])).write.mode("overwrite").parquet(self._path(level, n))
            level += 1

    def _expire(self, n: int) -> None:
        """Remove the parts of what batch n - 1 carried."""
        level = 1
        while n and n % self.fan**level == 0:
            p, fs = self._files(f"{self._path(level, n - 1)}/_SUCCESS")
            if not fs.exists(p):
                return
            for k in range(self.fan):
                p, fs = self._files(self._path(level - 1, n - 1 - k * self.fan ** (level - 1)))
                fs.delete(p, True)
            level += 1

    def read(self) -> DataFrame:
        """The table after the last complete batch."""
        lasts = [last for _, last in self._parts()]
        return self.fold.combine(self._read(self.covering(max(lasts)) if lasts else []))
