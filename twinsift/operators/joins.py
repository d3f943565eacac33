"""Joins in which a few keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.plans.storage import free_name

#: Most keys that can count as hot.
HOT_KEYS = 10_000
#: Rows of a hot key that go to one task.
HOT_ROWS = 1_000
#: Rows of either side that meet in one task of a tiled join. Rows are repeated once per block of the other side, so large blocks move less.
TILE_ROWS = 8_000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], spread: list[str], count: str = "n", hot_keys: int = HOT_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``counted``, whose keys are unique and whose ``count`` says how many rows a key has.

    A key with more than a ``hot_keys``-th of all rows is hot. There can be no more
    than ``hot_keys`` of them whatever the data, so these keys (and nothing else)
    are broadcast to ``rows``, whose rows of a hot key are dealt by a hash of
    ``spread`` into parts of about ``hot_rows``; the key's row in ``counted`` is
    repeated once a part. Then no task gets a large key. ``counted`` should be a
    stored table, as it is read several times.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    least = max(hot_rows, total // hot_keys + 1)
    parts = F.when(F.col(count) >= least, F.ceil(F.col(count) / hot_rows)).otherwise(1).cast("int")
    hot = counted.where(F.col(count) >= least)
    if hot.isEmpty():
        return rows.join(counted.hint("merge"), on)
    part, most = free_name(rows, "part"), free_name(rows, "parts")
    dealt = rows.join(F.broadcast(hot.select(*on, parts.alias(most))), on, "left")
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(*spread), F.coalesce(most, F.lit(1))).cast("int")).drop(most)
    repeated = counted.withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(repeated.hint("merge"), [*on, part]).drop(part)


def hot_counts(rows: DataFrame, on: list[str], hot_keys: int = HOT_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(*on, n)`` of the ``hot_keys`` most frequent keys with at least ``hot_rows`` rows.

    A key that is left out has less than a ``hot_keys``-th of all rows.
    """
    counted = rows.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows)
    return counted.orderBy(F.desc("n"), *on).limit(hot_keys)


def join_tiled(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, hot_keys: int = HOT_KEYS, hot_rows: int = TILE_ROWS) -> DataFrame:
    """Inner join in which the rows of a hot key are dealt into blocks on either side, and every pair of blocks is a key of its own.

    A task then meets about ``hot_rows`` rows of a key from either side, however many there
    are. Rows of a hot key are repeated once per block of the other side. Both
    sides should be stored tables or cheap to read, as their keys are counted first. They are never broadcast:
    rows that are exploded from a small file have the file's size in the optimizer's eyes.
    """
    counted = hot_counts(left, on, hot_keys, hot_rows).withColumnRenamed("n", "_l").join(hot_counts(right, on, hot_keys, hot_rows).withColumnRenamed("n", "_r"), on, "full")
    blocks = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(1)) / hot_rows).cast("int")
    # bounded by construction: at most hot_keys rows from either side
    found = counted.select(*on, blocks("_l").alias("_l"), blocks("_r").alias("_r"))
    found, schema = found.collect(), found.schema
    if not found:
        return left.join(right.hint("merge"), on)
    hot = left.sparkSession.createDataFrame(found, schema)

    def dealt(rows: DataFrame, id_col: str, own: str, other: str, own_tile: str, other_tile: str) -> DataFrame:
        known = rows.join(F.broadcast(hot), on, "left")
        tile = F.pmod(F.xxhash64(id_col), F.coalesce(own, F.lit(1))).cast("int")
        return known.withColumns({own_tile: tile, other_tile: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).drop("_l", "_r")

    return dealt(left, left_id, "_l", "_r", "_tl", "_tr").join(dealt(right, right_id, "_r", "_l", "_tr", "_tl").hint("merge"), [*on, "_tl", "_tr"]).drop("_tl", "_tr")
