"""Generations of a report or selection: written aside, then published by a pointer.

A table lives in ``<base>/<kind>/gen=<id>``; ``<base>/<kind>/active/<n>`` are
one-row tables, each naming a generation, of which the last complete one counts.
A pointer is a new table and never overwrites one, so a job that fails at any
moment leaves the published generation as it was. The generation before the
published one stays until the next is published, as readers may still scan it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "generation long, rows long"
CURRENT_VERSION = 1
READY, REBUILDING = "ready", "rebuilding"


class Generations:
    def __init__(self, spark: SparkSession, base: str, kind: str):
        self.spark, self.base = spark, f"{base}/{kind}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _pointers(self) -> list[int]:
        """Numbers of the pointer tables, half-written ones too."""
        fs, p = self._fs(f"{self.base}/active")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _published(self) -> list[int]:
        """Generations that complete pointers name, the present one last."""
        whole = [n for n in self._pointers() if self.exists(f"{self.base}/active/{n}/_SUCCESS")]
        return [self.spark.read.schema(_POINTER).parquet(f"{self.base}/active/{n}").first()["generation"] for n in whole]

    def active(self) -> int | None:
        """Published generation, or None."""
        return next(reversed(self._published()), None)

    def write(self, generation: int, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/gen={generation}/{name}")

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        """A table of the published (or a given) generation."""
        generation = self.active() if generation is None else generation
        if generation is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.base}/gen={generation}/{name}")

    def publish(self, generation: int, rows: int) -> None:
        """Point readers to a generation; all pointers and generations before the previous one go."""
        before = self._pointers()
        number = before[-1] + 1 if before else 0
        self.spark.createDataFrame([(generation, rows)], _POINTER).coalesce(1).write.parquet(f"{self.base}/active/{number}")
        keep = set(self._published()[-2:])
        whole = [n for n in before if self.exists(f"{self.base}/active/{n}/_SUCCESS")]
        for n in whole[:-1]:
            old = self.spark.read.schema(_POINTER).parquet(f"{self.base}/active/{n}").first()["generation"]
            self._drop(f"{self.base}/active/{n}")
            if old not in keep:
                self._drop(f"{self.base}/gen={old}")

    def generations(self) -> list[int]:
        fs, p = self._fs(self.base)
        if not fs.exists(p):
            return []
        return sorted(int(n[4:]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("gen="))

    def clean(self, unpublished: bool = False) -> list[int]:
        """Drop generations that no pointer names.

        Without any pointer nothing tells a new report from a lost pointer; then
        nothing is dropped unless ``unpublished`` says that nothing was published.
        """
        named = set(self._published())
        if not named and not unpublished:
            raise LookupError("nothing is published")
        stale = [g for g in self.generations() if g not in named]
        for g in stale:
            self._drop(f"{self.base}/gen={g}")
        return stale

    def drop(self, generation: int) -> None:
        """Drop a generation that no pointer names."""
        if generation in self._published():
            raise ValueError(f"generation {generation} is published")
        self._drop(f"{self.base}/gen={generation}")

    def drop_table(self, generation: int, name: str) -> None:
        """Drop one table of a generation that no pointer names."""
        if generation in self._published():
            raise ValueError(f"generation {generation} is published")
        self._drop(f"{self.base}/gen={generation}/{name}")

    def tables(self, generation: int) -> list[str]:
        """Names of a generation's tables, those in folders of their own too."""
        fs, p = self._fs(f"{self.base}/gen={generation}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())

    def copy(self, into: Generations, generation: int | None = None) -> int:
        """Back up the published (or a given) generation: copy its tables, compare their row counts, then publish the copy.

        Returns the number of rows copied. A copy that fails or differs is not published.
        """
        generation = self.active() if generation is None else generation
        if generation is None:
            raise LookupError("nothing is published")
        if generation in into._published():
            raise ValueError(f"generation {generation} is published there")
        rows = 0
        for name in self.tables(generation):
            into.write(generation, name, self.read(name, generation))
            had, has = self.read(name, generation).count(), into.read(name, generation).count()
            if had != has:
                raise RuntimeError(f"{name}: {had} rows, {has} in the copy")
            rows += has
        into.publish(generation, rows)
        return rows

    def delete_all(self) -> None:
        """Unpublish first, then drop the data."""
        self._drop(f"{self.base}/active")
        for g in self.generations():
            self._drop(f"{self.base}/gen={g}")


def schema_version(migrations: DataFrame, version: str = "schema_version") -> DataFrame:
    """Highest version that a table of migrations names, in one row; 0 if it is empty."""
    return migrations.agg(F.coalesce(F.max(version), F.lit(0)).cast("long").alias("schema_version"))


def version_decision(local: str, remote: str, current: int = CURRENT_VERSION) -> Column:
    """What to do with two stores' versions: RejectNewerData, ResetRequired, ReuseReady or ResumeRebuild.

    ``local`` and ``remote`` name struct columns (data_version, generation_id, state), null if missing.
    """
    l, r = (lambda c: F.col(f"{local}.{c}")), (lambda c: F.col(f"{remote}.{c}"))
    newer = F.coalesce(l("data_version") > current, F.lit(False)) | F.coalesce(r("data_version") > current, F.lit(False))
    same = (l("data_version") == current) & (r("data_version") == current) & (l("generation_id") != 0) & (l("generation_id") == r("generation_id"))
    return F.when(newer, "RejectNewerData").when(~F.coalesce(same, F.lit(False)), "ResetRequired").when((l("state") == READY) & (r("state") == READY), "ReuseReady").otherwise("ResumeRebuild")
