"""Keyed tables written by micro-batches: a log-structured merge of folders.

Batch n writes the rows it changed to a folder of level 0. Whenever `FANOUT` folders of a level are complete they are merged
into one of the next level, newest row of a key first, so a table of b batches lives in less than FANOUT folders a level and
a row is rewritten once a level, not once a batch. Which folders are live before a batch follows from its number alone:
nothing is listed, a replayed batch writes the same folders again, and no reader sees half a merge. Folders that have been
merged are removed one batch later, when the batch that merged them can't be replayed any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8


class KeyedLog:
    """Rows (keys, other columns) at ``root``; of the rows of a key the one of the newest batch counts. A batch holds one
    row of a key: of several, the greatest by all other columns in their order is taken.

    ``first``: text columns that a key keeps from the oldest batch in which they aren't blank. Batches needn't read old rows
    for them, they come together when folders are merged or read. A row without a complete key has no older one.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], fanout: int = FANOUT, first: Sequence[str] = ()):
        self.spark, self.root, self.keys, self.fanout, self.first = spark, root, list(keys), fanout, list(first)
        self.schema, self.values = schema, [c for c in schema.names if c not in keys]
        self.logged = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])

    def live(self, before: int) -> list[tuple[int, int]]:
        """Folders (level, number) that hold the batches before that one, oldest first."""
        level, folders, at = 0, [], 0
        while self.fanout ** (level + 1) <= before:
            level += 1
        for k in range(level, -1, -1):
            span = self.fanout**k
            while at + span <= before:
                folders.append((k, at // span))
                at += span
        return folders

    def _path(self, folder: tuple[int, int]) -> str:
        return f"{self.root}/level={folder[0]}/part={folder[1]}"

    def _read(self, folders: list[tuple[int, int]]) -> DataFrame:
        if not folders:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.logged.fields]
            return self.spark.range(1).where(F.lit(False)).select(*nothing)
        return self.spark.read.schema(self.logged).parquet(*[self._path(f) for f in folders])

    def _newest(self, rows: DataFrame) -> DataFrame:
        complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        oldest = [F.min(F.when(complete & (F.col(c) != ""), F.struct("batch", c))).alias(f"_{c}") for c in self.first]
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("batch", *self.values)).alias("row"), *oldest)

        def value(c: str) -> Column:
            if c in self.keys:
                return F.col(c)
            return (F.coalesce(f"_{c}.{c}", f"row.{c}") if c in self.first else F.col(f"row.{c}")).alias(c)

        return newest.select(*[value(c) for c in self.schema.names], "row.batch")

    def before(self, number: int, only: DataFrame | None = None) -> DataFrame:
        """The table before a batch, or its rows with the keys of ``only``."""
        rows = self._read(self.live(number))
        if only is not None:
            rows = rows.join(only, self.keys, "left_semi")
        return self._newest(rows).drop("batch")

    def write(self, rows: DataFrame, number: int, unique: bool = False) -> None:
        """Write the rows of a batch and merge what is complete with it. ``unique``: the rows hold a key once, so they are
        written where they are."""
        self._forget(number)
        one = rows.select(*self.schema.names, F.lit(number).alias("batch"))
        if not unique:
            one = self._newest(one)
        one.write.mode("overwrite").parquet(self._path((0, number)))
        for level, parts in self._merges(number):
            merged = self._newest(self._read(parts))
            merged.write.mode("overwrite").parquet(self._path((level, parts[-1][1] // self.fanout)))

    def _merges(self, number: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """Levels that a batch completes, with the folders that are merged into them."""
        found, level = [], 1
        while (number + 1) % self.fanout**level == 0:
            last = (number + 1) // self.fanout ** (level - 1) - 1
            found.append((level, [(level - 1, last - k) for k in range(self.fanout - 1, -1, -1)]))
            level += 1
        return found

    def _forget(self, number: int) -> None:
        """Remove what the batch before this one has merged."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for _, parts in self._merges(number - 1) if number else []:
            for folder in parts:
                path = jvm.org.apache.hadoop.fs.Path(self._path(folder))
                path.getFileSystem(conf).delete(path, True)
