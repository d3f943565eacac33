"""A table in hash partitions, of which a merge rewrites the touched ones only.

Rows lie in ``<base>/data/gen=<n>/bucket=<k>``; a manifest, published as a generation of
its own, names for each bucket the generation that holds it. A merge reads
the buckets that its changes fall into, writes them as a new generation and publishes a
manifest in which all other buckets keep their files. A merge that fails before that leaves
the table as it was; a repeated one writes a generation of its own. Only numbers of
buckets (no more than ``buckets``) reach the driver.

Keys are not null. Of several changes of a key in one merge the last counts; repeated
rows of a key are one row. An empty table reads as no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.ingest import latest_operations
from twinsift.plans.generations import Generations

_MANIFEST = "bucket int, gen long"


class MergedTable:
    def __init__(self, spark: SparkSession, base: str, schema: str, key: str, buckets: int = 256):
        self.spark, self.base, self.schema, self.key, self.buckets = spark, base, schema, key, buckets
        self.manifests = Generations(spark, base, "manifest")

    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict[int, int]:
        """Generation of each bucket that has rows."""
        if self.manifests.active() is None:
            return {}
        return {r["bucket"]: r["gen"] for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.manifests.base}/gen={self.manifests.active()}/buckets").collect()}

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/data/gen={g}/bucket={b}" for b, g in sorted(manifest.items())])

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def merge(self, changes: DataFrame, kind: str = "kind", order: str = "sequence", delete: str = "delete", compare: tuple[str, ...] = (), derive: Callable[[DataFrame], DataFrame] | None = None) -> list[int]:
        """Apply upserts and deletes, the last of each key by ``order``; returns the buckets rewritten.

        A delete takes a row only if it agrees in the columns of ``compare``. ``derive`` maps the
        rows of upserts to those stored.
        """
        last = latest_operations(changes, [self.key], order).withColumn("_b", self._bucket(self.key))
        before = self.manifest()
        touched = sorted(r["_b"] for r in last.select("_b").distinct().collect())
        if not touched:
            return []
        generation = max([0, *self.manifests.generations()]) + 1
        columns = [c.split()[0] for c in self.schema.split(", ")]
        old = self._read({b: g for b, g in before.items() if b in touched})
        gone = last.select(F.col(self.key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in compare], (F.col(kind) == delete).alias("_d"))
        same = F.lit(True)
        for c in compare:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        kept = old.join(gone, (F.col(self.key) == F.col("_k")) & (~F.col("_d") | same), "left_anti")
        put = last.where(F.col(kind) != delete)
        put = (derive(put) if derive else put).select(*columns)
        rows = kept.select(*columns).unionByName(put).withColumn("bucket", self._bucket(self.key))
        target = f"{self.base}/data/gen={generation}"
        rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        has_rows = [b for b in touched if self.manifests.exists(f"{target}/bucket={b}")]
        after = {b: g for b, g in before.items() if b not in touched} | dict.fromkeys(has_rows, generation)
        self.manifests.write(generation, "buckets", self.spark.createDataFrame(sorted(after.items()), _MANIFEST).coalesce(1))
        self.manifests.publish(generation, len(after))
        return touched

    def vacuum(self) -> None:
        """Drop the files that neither the published manifest nor the one before names."""
        named = set()
        for n in self.manifests.generations():
            named |= {(r["gen"], r["bucket"]) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.manifests.base}/gen={n}/buckets").collect()}
        data = Generations(self.spark, self.base, "data")
        for g in data.generations():
            for name in data.tables(g):
                if name.startswith("bucket=") and (g, int(name[7:])) not in named:
                    data._drop(f"{data.base}/gen={g}/{name}")
