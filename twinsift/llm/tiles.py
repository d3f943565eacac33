"""Verification of candidate buckets in tiles: Jaccard links between the sets of a bucket's members.

A bucket of more than ``block`` members (or of sets of more than ``BLOCK_SIZE``
values) is dealt by hash into blocks, and every pair of blocks is a tile of its
own, so no bucket is collected whole. A pair that shares several buckets is
verified in the first one only. Where sketches are given, members that cannot have a
partner by lengths and sketches are left out before any set travels. The work in a bucket of N members grows with the
square of N, as every pair is verified; rows shuffled grow with N * N / block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.joins import join_counted
from twinsift.plans.storage import materialize

BLOCK = 128
BLOCK_SIZE = 250_000
SetOf = Callable[[bytes], np.ndarray]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of arrays of distinct values."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # values of one array add nothing, values of all arrays add one to every pair
    shared = (seen[at] > 1) & (seen[at] < g)
    owner, (_, at) = owner[shared], np.unique(at[shared], return_inverse=True)
    out, width, step = np.full((g, g), (seen == g).sum(), np.float32), int(at.max()) + 1 if len(at) else 0, max(256, 4_000_000 // g)
    for lo in range(0, width, step):
        here = (at >= lo) & (at < lo + step)
        x = np.zeros((g, min(step, width - lo)), np.float32)
        x[owner[here], at[here] - lo] = 1
        out += x @ x.T
    return out


def _linked(rows: list[dict], bucket: int, crossing: bool, threshold: float, set_of: SetOf) -> list[tuple[int, int, int]]:
    """``(id, root, links)`` of each row of a tile that has a link verified in it."""
    sets = [set_of(r["payload"]) for r in rows]
    sizes, left = np.array([len(s) for s in sets], np.float32), np.array([r["left"] for r in rows], np.float32)
    # neither the lengths nor what is left behind the bucket's value may rule a pair out
    link = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-3
    link &= np.minimum.outer(left, left) >= threshold / (1 + threshold) * np.add.outer(sizes, sizes) - 1e-3
    np.fill_diagonal(link, False)
    if crossing:
        block = np.array([r["block"] for r in rows])
        link &= block[:, None] != block[None, :]
    before = [np.array([b for b in r["buckets"] if b < bucket], np.int64) for r in rows]
    link &= _common(before) == 0  # verified in an earlier bucket
    open_rows = np.flatnonzero(link.any(axis=1))
    if not len(open_rows):
        return []
    rows, sets, sizes, link = [rows[i] for i in open_rows], [sets[i] for i in open_rows], sizes[open_rows], link[np.ix_(open_rows, open_rows)]
    common = _common(sets)
    link &= common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    weights = link @ np.array([r["copies"] for r in rows], np.int64)
    ids = np.array([r["doc_id"] for r in rows])
    root, settled = ids.copy(), False
    while not settled:
        low = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, low)
        settled = bool((new == root).all())
        root = new
    return [(int(i), int(r), int(w)) for i, r, w in zip(ids, root, weights, strict=True) if w]


def parity_sketch(values: np.ndarray) -> bytes:
    """A bit for each remainder of the values that an odd number of them has; as many bits as a power of two from 64 and their number on.

    Two sets differ in at least as many values as their sketches differ in bits, and the halves of
    a sketch, one put on the other by XOR, are the sketch of half as many bits.
    """
    bits = 64
    while bits < len(values):
        bits *= 2
    return np.packbits(np.bincount(values & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _apart(a: bytes, b: bytes) -> int:
    """Bits that differ when the longer sketch is folded to the shorter one's length."""
    if len(a) > len(b):
        a, b = b, a
    x, size = int.from_bytes(b, "big"), len(b)
    while size > len(a):
        size //= 2
        x = (x >> 8 * size) ^ (x & (1 << 8 * size) - 1)
    return (x ^ int.from_bytes(a, "big")).bit_count()


def _open_rows(rows: list[dict], crossing: bool, threshold: float) -> list[dict]:
    """Rows of a tile that lengths, what is left and sketches leave a possible partner."""
    differ = (1 - threshold) / (1 + threshold)

    def possible(x, y) -> bool:
        if not x["payload"] or not y["payload"]:  # an id with several sets: the sets themselves decide
            return True
        s, t = x["size"], y["size"]
        if min(s, t) < threshold * max(s, t) - 1e-3 or min(x["left"], y["left"]) < threshold / (1 + threshold) * (s + t) - 1e-3:
            return False
        return not (crossing and x["block"] == y["block"]) and _apart(x["payload"], y["payload"]) <= differ * (s + t) + 1e-3

    if len(rows) <= 12 or not all(r["payload"] for r in rows):
        found = [False] * len(rows)
        for i, x in enumerate(rows):
            for j in range(i):
                if not (found[i] and found[j]) and possible(x, rows[j]):
                    found[i] = found[j] = True
        return [r for r, f in zip(rows, found, strict=True) if f]
    sizes, left, block = (np.array([r[c] for r in rows], np.float32) for c in ("size", "left", "block"))
    link = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-3
    link &= np.minimum.outer(left, left) >= threshold / (1 + threshold) * np.add.outer(sizes, sizes) - 1e-3
    np.fill_diagonal(link, False)
    if crossing:
        link &= block[:, None] != block[None, :]
    lengths = np.array([len(r["payload"]) for r in rows])
    by = {int(n): (np.flatnonzero(lengths == n), np.frombuffer(b"".join(r["payload"] for r in rows if len(r["payload"]) == n), np.uint8).reshape(-1, n)) for n in np.unique(lengths)}
    for n, (own, sketches) in by.items():
        for m, (others, longer) in by.items():
            if m >= n:
                folded = _folded(longer, n)
                apart = np.stack([np.bitwise_count(x ^ folded).sum(axis=1, dtype=np.int64) for x in sketches])
                near = apart <= differ * np.add.outer(sizes[own], sizes[others]) + 1e-3
                link[np.ix_(own, others)] &= near
                link[np.ix_(others, own)] &= near.T
    return [r for r, f in zip(rows, link.any(axis=1).tolist(), strict=True) if f]


def _tiles(batches: Iterator, several: bytes | None = None) -> Iterator[tuple[tuple, list[dict]]]:
    """``(bucket, ti, tj)`` and rows of each tile of two members or more.

    Of different payloads of an id the least counts, or ``several`` stands for them.
    """
    held, key = {}, None
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["bucket"], r["ti"], r["tj"])
            if now != key:
                if len(held) > 1:
                    yield key, list(held.values())
                held, key = {}, now
            other = held.setdefault(r["doc_id"], r)  # a repeated row counts once
            if r["payload"] != other["payload"]:
                other["payload"] = min(r["payload"], other["payload"]) if several is None else several
    if len(held) > 1:
        yield key, list(held.values())


_OPEN = "rep long, size int, copies long, bucket long, left int, blocks int"


def _unpruned(threshold: float):
    def prune(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in _OPEN.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in _OPEN.split(", ")]

        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        out: list[tuple] = []
        for (bucket, ti, tj), rows in _tiles(batches, b""):
            out += [(r["doc_id"], r["size"], r["copies"], bucket, r["left"], r["blocks"]) for r in _open_rows(rows, ti != tj, threshold)]
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return prune


def _verify(threshold: float, set_of: SetOf):
    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple[int, int, int]] = []
        for (bucket, ti, tj), rows in _tiles(batches):
            out += _linked(rows, bucket, ti != tj, threshold, set_of)
            if len(out) > 20_000:
                yield _links_batch(pa, out)
                out = []
        yield _links_batch(pa, out)

    return verify


def _links_batch(pa, out):
    columns = zip(*out, strict=True) if out else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "root", "links"])


def _in_tiles(members: DataFrame, data: DataFrame) -> DataFrame:
    """Rows of ``data`` beside each of their buckets, in every tile of it; tiles lie one behind the other."""
    own = members.groupBy("rep").agg(F.first("copies").alias("copies"), F.first("size").alias("size"), F.collect_list(F.struct("bucket", "blocks", "left")).alias("in"))
    own = materialize(own, "members")  # a member's own buckets in each array

    # sort-merge at every size: the members grow with the input
    placed = data.join(own.hint("merge"), own["rep"] == data["doc_id"]).select("doc_id", "payload", "copies", "size", F.transform("in", lambda b: b["bucket"]).alias("buckets"), F.explode("in").alias("b"))
    placed = placed.select("doc_id", "payload", "copies", "size", "buckets", "b.bucket", "b.blocks", "b.left", F.pmod(F.xxhash64("doc_id", "b.bucket"), F.col("b.blocks")).cast("int").alias("block"))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})
    return tiled.drop("other")


def _side_by_side(tiled: DataFrame) -> DataFrame:
    return tiled.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj")


def bucket_links(spread: DataFrame, data: DataFrame, set_of: SetOf, threshold: float, block: int = BLOCK, sketches: DataFrame | None = None) -> DataFrame:
    """``(doc_id, root, links)``: per tile each member with links, its root in the tile's forest of links, and their number.

    ``spread`` has a row per member and bucket: ``rep``, ``size`` (of its set),
    ``copies`` and ``bucket``, and ``left`` if a member's set can share no more than so many
    values with another one that it first meets in this bucket. ``data`` holds ``doc_id`` and ``payload``, the bytes
    from which ``set_of`` makes an array of distinct values; of several rows of an id
    the least payload counts. Buckets of one, and all but one of several buckets with
    the same members, are left out. ``sketches`` holds the ``parity_sketch`` of each set (whose ``size`` must then
    be exact) as ``payload`` by ``doc_id``: a row without a possible partner in a bucket goes before the sets are read.
    """
    spread = spread if "left" in spread.columns else spread.withColumn("left", F.col("size"))
    sized = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("n > 1")
    kept = materialize(sized.groupBy("n", "w", "x", "y").agg(F.min("bucket").alias("bucket")), "buckets")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("w") / BLOCK_SIZE)).cast("int")
    members = join_counted(spread, kept.select("bucket", "n", blocks.alias("blocks")), ["bucket"], ["rep"])
    if sketches is not None:
        meant = _in_tiles(members, sketches).drop("buckets")
        members = materialize(_side_by_side(meant).mapInArrow(_unpruned(threshold), _OPEN).distinct(), "open")
    rows = _in_tiles(members, data).select("doc_id", "payload", "copies", "buckets", "bucket", "left", "block", "ti", "tj")
    return materialize(_side_by_side(rows).mapInArrow(_verify(threshold, set_of), "doc_id long, root long, links long"), "links")
