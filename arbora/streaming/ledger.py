"""Log-structured tables of keyed statistics, for streams whose tables outgrow their batches.

Each batch appends only the rows it changed, as `delta/version=<batch id>`; a read merges them by key,
and every so many versions the merged table becomes `base/version=<batch id>`. What is written for a
batch follows the batch, not the table. A batch that is replayed overwrites its own rows, and all that
it reads, versions below its own, is still there: compaction keeps the base before the newest one and
everything since. A reader must end within `every` batches of its start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arbora.functions.lineage import remove_folder


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of a table that were written as a whole."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


@dataclass(frozen=True)
class Ledger:
    """A table of `schema` (DDL) with unique `keys`.

    `merge` says what rows of one key become: `sum` adds their values up, `last` takes those of the
    highest version. `every` is the number of versions between compactions.
    """

    folder: str
    schema: str
    keys: tuple[str, ...]
    merge: str = "sum"
    every: int = 8

    @property
    def values(self) -> list[str]:
        return [c for c in StructType.fromDDL(self.schema).names if c not in self.keys]

    def _merged(self, rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(*self.keys)
        if self.merge == "sum":
            return grouped.agg(*[F.sum(c).alias(c) for c in self.values])
        newest = grouped.agg(F.max_by(F.struct(*self.values), "version").alias("_v"), F.max("version").alias("version"))
        return newest.select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in self.values], "version")

    def _stored(self) -> str:
        return self.schema if self.merge == "sum" else f"{self.schema}, version long"

    def append(self, rows: DataFrame, version: int) -> None:
        """The rows of one batch, already one a key; compacts where the version is due."""
        out = rows.select(*self.keys, *self.values)
        if self.merge == "last":
            out = out.withColumn("version", F.lit(version).cast("long"))
        out.write.mode("overwrite").parquet(f"{self.folder}/delta/version={version}")
        if (version + 1) % self.every == 0:
            self.compact(rows.sparkSession, version)

    def read(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The merged table of all versions (below `before`), or None if there is none.

        `only` holds values of some of the keys: cells of other keys are left out before the merge, so
        that a batch reads the cells it needs and exchanges no more than these.
        """
        found = self._files(spark, before)
        if not found:
            return None
        rows = spark.read.schema(self._stored()).parquet(*found)
        if only is not None:
            rows = rows.join(only, only.columns, "left_semi")
        return self._merged(rows).drop("version")

    def _files(self, spark: SparkSession, before: int | None) -> list[str]:
        usable = lambda kind: [v for v in versions(spark, f"{self.folder}/{kind}") if before is None or v < before]
        base = usable("base")[-1:]
        deltas = [v for v in usable("delta") if not base or v > base[0]]
        return [*(f"{self.folder}/base/version={v}" for v in base), *(f"{self.folder}/delta/version={v}" for v in deltas)]

    def compact(self, spark: SparkSession, version: int) -> None:
        """Writes the merged table as of `version`, then removes what no read below it needs."""
        rows = spark.read.schema(self._stored()).parquet(*self._files_up_to(spark, version))
        self._merged(rows).write.mode("overwrite").parquet(f"{self.folder}/base/version={version}")
        earlier = [v for v in versions(spark, f"{self.folder}/base") if v < version]
        if earlier:
            for v in earlier[:-1]:
                remove_folder(spark, f"{self.folder}/base/version={v}")
            for v in versions(spark, f"{self.folder}/delta"):
                if v <= earlier[-1]:
                    remove_folder(spark, f"{self.folder}/delta/version={v}")

    def _files_up_to(self, spark: SparkSession, version: int) -> list[str]:
        base = [v for v in versions(spark, f"{self.folder}/base") if v < version][-1:]
        deltas = [v for v in versions(spark, f"{self.folder}/delta") if v <= version and (not base or v > base[0])]
        return [*(f"{self.folder}/base/version={v}" for v in base), *(f"{self.folder}/delta/version={v}" for v in deltas)]
