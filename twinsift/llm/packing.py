"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

A document is its ids followed by an end id. A document longer than a sequence
is cut into full pieces behind a first piece that takes the remainder. Full
pieces are sequences of their own; every other piece goes through sum-of-squares
packing: it is placed in that open sequence for which the sum, over all residual
gaps, of the squared number of open sequences with that gap becomes smallest. A
new sequence is opened only where no open one has room, and pieces come longest
first; on the test tables this takes one sequence more than the least possible
number, where opening sequences freely takes one in a hundred more.

Distribution: only ``(doc_id, piece, length)`` rows are shuffled, never ids. They
are dealt by hash into shards of about ``SHARD_PIECES`` pieces whose number
follows the input, one shard a task, and each shard is packed by itself. The
hash takes the row's place in the stored table too, so that equal rows spread and
a shard is bounded whatever the key or source of its documents. Each shard leaves
a few unfilled sequences.

Null text is the empty text and gives one piece that holds the end id alone.
Repeated rows are packed as often as they occur. An empty table gives no rows.
Other columns of the documents are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.bpe import codec, default_pattern
from twinsift.plans.storage import arrow_rows, materialize

SEQUENCE_TOKENS = 1024
END_ID = 2
SHARD_PIECES = 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece of a document of ``n`` tokens."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(df: DataFrame, ranks_path: str, end_id: int = END_ID, capacity: int = SEQUENCE_TOKENS, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece; ``with_ids`` adds the packed ids of each piece. ``added`` are ``(text, id)`` of added tokens."""
    pattern = default_pattern()
    arrow_rows(df.sparkSession)

    def tokenise(batches):
        import pyarrow as pa

        own = codec(ranks_path, pattern, added)
        for batch in batches:
            ids_out, piece_out, start_out, length_out, crc_out, raw_out = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.ids(text)
                ids.append(end_id)
                packed = memoryview(np.array(ids, dtype="<u4").tobytes())
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = packed[4 * start : 4 * (start + length)]
                    ids_out.append(doc)
                    piece_out.append(k)
                    start_out.append(start)
                    length_out.append(length)
                    crc_out.append(zlib.crc32(part))
                    if with_ids:
                        raw_out.append(bytes(part))
            columns = [pa.array(ids_out, pa.int64()), pa.array(piece_out, pa.int32()), pa.array(start_out, pa.int64()), pa.array(length_out, pa.int64()), pa.array(crc_out, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raw_out, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tokenise, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the order given."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by residual gap; a full bin (gap 0) never counts
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1), or by 1 - 2 n[g] when it fills up.
        there = open_bins[size:capacity]
        change = 2 * (open_bins[: capacity - size] - there + 1)
        change[:1] -= 1
        change[there == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and there[best]:
            gap = best + size
            bins[i] = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap = capacity
            bins[i] = made
            made += 1
        offsets[i] = capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            stacks[gap - size].append(int(bins[i]))
    return bins, offsets


def _pack_shards(capacity: int):
    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def packed(rows: pa.Table):
            bins, offsets = sum_of_squares(rows.column("length").to_numpy(), capacity)
            shard = rows.column("shard")[0].as_py()
            out = rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (shard << 32))).append_column("offset", pa.array(offsets))
            yield from out.combine_chunks().to_batches()

        held: list = []
        for batch in batches:
            shards = batch.column("shard")
            begin = 0
            while begin < batch.num_rows:
                now = shards[begin].as_py()
                if held and held[0].column("shard")[0].as_py() != now:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                end = begin + int(pc.sum(pc.equal(shards.slice(begin), now)).as_py())
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from packed(pa.Table.from_batches(held))

    return pack


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``token_pieces``.

    ``pieces`` should be a stored table: it is read for a count and for packing.
    """
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))
    placed = (
        rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
        .repartitionById(shards, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
        .mapInArrow(_pack_shards(capacity), f"{PIECES}, sequence_id long, offset long")
    )
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone)


def pack_documents(df: DataFrame, ranks_path: str, text_col: str = "text", id_col: str = "doc_id", added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece."""
    return pack(materialize(token_pieces(df, ranks_path, text_col=text_col, id_col=id_col, added=added), "pieces"))
