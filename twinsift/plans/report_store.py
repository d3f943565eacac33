"""What a similarity report keeps beside its groups, and pages of it.

Each table lies in one generation (``Generations``) and is read once that is
published. Rows are numbered over the whole table in the order of their group and
rank, in key ranges, so a group of any size is cut like all others; an index holds
the first number of each group. A page of a group is a range of numbers, which a
scan finds by the files' minima and maxima. Nothing is left out above a size: all
skipped contents are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.report import page, with_ordinals
from twinsift.plans.generations import Generations

RULES, SKIPPED, RELATIONS, MEMBERS = "rules", "skipped", "relations", "signature_members"


class ReportStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.stored = spark, Generations(spark, base, "similar")

    def begin(self) -> int:
        """Number of a new report."""
        return max([*self.stored.generations(), -1]) + 1

    def save_rules(self, number: int, rules: dict) -> None:
        """Snapshot of the rules (thresholds, versions) that the report was made by."""
        self.stored.write(number, RULES, self.spark.createDataFrame([(json.dumps(rules, sort_keys=True),)], "rules string").coalesce(1))

    def rules(self) -> dict:
        return json.loads(self.stored.read(RULES).first()["rules"])

    def save(self, number: int, name: str, rows: DataFrame, order: list[str], group: str | None = None) -> None:
        """Write a table in the order of ``group``, then ``order``; equal rows are numbered one after the other."""
        keys = [*([group] if group else []), *order]
        self.stored.write(number, name, with_ordinals(rows, F.struct(*keys)))
        if group:
            starts = self.stored.read(name, number).groupBy(group).agg(F.min("ordinal").alias("first"), F.count("*").alias("rows"))
            self.stored.write(number, f"{name}_index", starts)

    def publish(self, number: int) -> None:
        self.stored.publish(number, sum(self.stored.read(n, number).count() for n in self.stored.tables(number)))

    def counts(self, name: str) -> DataFrame:
        """Number of rows of each group of a table."""
        return self.stored.read(f"{name}_index").drop("first")

    def page(self, name: str, offset: int, count: int) -> DataFrame:
        """Rows ``offset`` to ``offset + count`` of a whole table, with ``ordinal``."""
        return page(self.stored.read(name), offset, count)

    def group_page(self, name: str, group: str, value, offset: int, count: int) -> DataFrame:
        """Rows ``offset`` to ``offset + count`` of one group, with their ``ordinal`` in it; none for an unknown group."""
        entry = self.stored.read(f"{name}_index").where(F.col(group).eqNullSafe(F.lit(value))).first()
        first, rows = (entry["first"], entry["rows"]) if entry else (0, 0)
        found = page(self.stored.read(name), first + offset, max(0, min(count, rows - offset)))
        return found.withColumn("ordinal", F.col("ordinal") - first)
