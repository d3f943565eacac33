"""Store of the files selected for deletion, by group: replaced as a whole or group by group, never half.

Every state is a generation: it is written aside and read only once it is published
(``Generations``), so a replacement that fails or is discarded changes nothing. What a
replacement holds is known from its folders alone: another session can go on with it, and a
batch whose writing failed does not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.plans.generations import Generations

SELECTION = "group_id long, path_id long, retained_path_id long, size_bytes long"
_COLUMNS = [c.split()[0] for c in SELECTION.split(", ")]


class SelectionStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.stored = spark, Generations(spark, base, "selection")

    def _batches(self, number: int) -> list[int]:
        """Batches of a replacement that were written to the end."""
        named = [int(t[6:]) for t in self.stored.tables(number) if t.startswith("batch=")]
        return sorted(k for k in named if self.stored.exists(f"{self.stored.base}/gen={number}/batch={k}/_SUCCESS"))

    def present(self) -> DataFrame:
        """The published selection; empty if there is none."""
        now = self.stored.active()
        if now is None or not self.stored.exists(f"{self.stored.base}/gen={now}"):
            return self.spark.createDataFrame([], SELECTION)
        return self.spark.read.schema(SELECTION).parquet(f"{self.stored.base}/gen={now}/batch=*")

    def begin(self) -> int:
        """Number of a new replacement, which starts empty."""
        number = max([*self.stored.generations(), -1]) + 1
        self.save(number, self.spark.createDataFrame([], SELECTION))
        return number

    def save(self, number: int, rows: DataFrame) -> None:
        """Add rows to a replacement that has begun; a batch that failed is written over."""
        done = self._batches(number)
        self.stored.write(number, f"batch={done[-1] + 1 if done else 0}", rows.select(*[F.col(c).cast("long") for c in _COLUMNS]))

    def publish(self, number: int) -> None:
        """Publish a replacement without the batches that were not written to the end."""
        done = self._batches(number)
        for name in self.stored.tables(number):
            if name.startswith("batch=") and int(name[6:]) not in done:
                self.stored.drop_table(number, name)
        self.stored.publish(number, sum(self.stored.read(f"batch={k}", number).count() for k in done))

    def discard(self, number: int) -> None:
        self.stored.drop(number)

    def set_groups(self, groups: DataFrame, rows: DataFrame) -> None:
        """Replace the selection of the groups in ``groups`` (``group_id``) by their rows in ``rows``; others stay."""
        number = self.begin()
        self.save(number, self.present().join(groups.select("group_id"), "group_id", "left_anti"))
        self.save(number, rows.join(groups.select("group_id"), "group_id", "left_semi"))
        self.publish(number)

    def clear(self) -> None:
        """Publish an empty selection."""
        self.publish(self.begin())

    def cleanup(self) -> list[int]:
        """Drop replacements that were neither published nor discarded."""
        return self.stored.clean()
