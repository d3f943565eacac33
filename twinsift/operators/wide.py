"""Near pairs of arrays of 64-bit words in NumPy, by 16-bit segments of which one differs in a bit at most.

Two 16-bit values with at most one differing bit agree in their upper or in their lower byte. So a row goes to
two groups of each segment, by one byte, and there it meets the rows of the group whose other byte is equal or one bit apart:
these are found by binary search in the group's sorted values, and nothing is sent for neighbouring values. Groups
hold a range of bytes, as large as the number of rows asks for. A group that holds very many rows is dealt into
tiles, and each pair of tiles is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group, on average; of a tile of a group that has many more.
GROUP_ROWS, TILE_ROWS = 16_384, 65_536
#: Pairs that are looked at together.
CELLS = 1 << 19
#: Groups of one task, at most on average.
TASK_GROUPS = 16


def _compare(radius: int, count: int, cells: int):
    def compare(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part = rows["part"][0].as_py()
        segment, lower = part // 2, part % 2  # a pair with equal values is the upper byte's

        def side(number: int):
            own = rows.filter(pc.equal(rows["side"], number)).combine_chunks()
            own = own.take(pc.sort_indices(own["key"]))
            words = own["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, count)
            return own["id"].combine_chunks(), own["key"].to_numpy().astype(np.int64), [np.ascontiguousarray(words[:, k]) for k in range(count)]

        same = rows["i"][0] == rows["up"][0]  # a tile beside itself
        ids, keys, words = side(0)
        ids2, keys2, words2 = (ids, keys, words) if same else side(1)
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]

        def meet(a, low, high):
            """Keep the near ones of row a of the left with rows low .. high - 1 of the right."""
            some = high > low
            a, low, n = a[some], low[some], (high - low)[some]
            upto = np.cumsum(n)
            at = 0
            while at < len(a):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + cells, "right")))
                m = n[at:end]
                left = np.repeat(a[at:end], m)
                right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[at:end], m)
                total = np.zeros(len(left), np.int32)
                for k in range(count):
                    total += np.bitwise_count(words[k][left] ^ words2[k][right])
                    near = total <= radius
                    left, right, total = left[near], right[near], total[near]
                for s in range(segment):  # a pair belongs to the first segment that matches
                    shift = np.uint64(48 - 16 * (s % 4))
                    apart = ((words[s // 4][left] ^ words2[s // 4][right]) >> shift) & np.uint64(0xFFFF)
                    new = np.bitwise_count(apart) > 1
                    left, right, total = left[new], right[new], total[new]
                found.append((left, right, total))
                at = end

        every = np.arange(len(keys))
        if not lower:
            meet(every, every + 1 if same else np.searchsorted(keys2, keys, "left"), np.searchsorted(keys2, keys, "right"))
        for bit in (1 << b for b in range(8)):
            a = every[keys & bit == 0] if same else every
            wanted = keys[a] ^ bit
            meet(a, np.searchsorted(keys2, wanted, "left"), np.searchsorted(keys2, wanted, "right"))
        left, right, total = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([ids.take(pa.array(left)), ids2.take(pa.array(right)), pa.array(total, pa.int32())], ["left_id", "right_id", "distance"])

    return compare


def wide_pairs(rows: DataFrame, radius: int, count: int, group_rows: int = GROUP_ROWS, tile_rows: int = TILE_ROWS, cells: int = CELLS) -> DataFrame:
    """``(left_id, right_id, distance)`` of all pairs of ``(id, w)`` rows within ``radius``, less than twice the segments, left id smaller.

    ``w`` is an array of ``count`` words without nulls; it is read three times, so it should be a stored table or cheap to read.
    """
    if radius >= 8 * count:
        raise ValueError("at most one bit of a segment may differ")
    byte_bits = max(0, min(8, (-(-rows.count() // group_rows) - 1).bit_length()))
    entries = []
    for s in range(4 * count):
        key = F.shiftrightunsigned(F.get("w", F.lit(s // 4)), 48 - 16 * (s % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int")
        turned = F.shiftleft(key.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(key, 8))
        entries += [F.struct(F.lit(2 * s).alias("part"), key.alias("key")), F.struct(F.lit(2 * s + 1).alias("part"), turned.alias("key"))]
    range_of = F.shiftright("key", 16 - byte_bits)
    keyed = lambda *columns: rows.select(*columns, F.explode(F.array(*entries)).alias("e")).select(*columns, "e.*").withColumn("range", range_of)
    # at most 256 ranges of a byte, two for each segment
    sizes = keyed().groupBy("part", "range").agg(F.count("*").alias("n")).collect()
    spark = rows.sparkSession
    tiles = {(r["part"], r["range"]): -(-r["n"] // tile_rows) for r in sizes}
    hot = [(p, g, t) for (p, g), t in tiles.items() if t > 1]
    sent = keyed("id", "w")
    if hot:
        sent = sent.join(F.broadcast(spark.createDataFrame(hot, "part int, range int, tiles int")), ["part", "range"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        sent = sent.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, tiles - 1)")))
        sent = sent.select("id", "w", "key", "part", "range", F.least("tile", "j").alias("i"), F.greatest("tile", "j").alias("up"), (F.col("j") < F.col("tile")).cast("int").alias("side"))
    else:
        sent = sent.select("id", "w", "key", "part", "range", F.lit(0).alias("i"), F.lit(0).alias("up"), F.lit(0).alias("side"))
    groups = sum(t * (t + 1) // 2 for t in tiles.values())
    tasks = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), groups // TASK_GROUPS)
    place = ["part", "range", "i", "up"]
    kind = dict(rows.dtypes)["id"]
    met = sent.repartition(tasks, *place).groupBy(*place).applyInArrow(_compare(radius, count, cells), f"left_id {kind}, right_id {kind}, distance int")
    return met.where("left_id <> right_id").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "distance")
