"""Texts as compressed bytes while they are shuffled."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_text(text: str) -> bytes:
    return zstandard.compress(text.encode("utf-8", "surrogatepass"), 3)


def unpack_text(data: bytes) -> str:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass")


def packed(text: Column) -> Column:
    """Binary column; null stays null."""

    @F.arrow_udf("binary")
    def packed_text(texts):
        import pyarrow as pa

        return pa.array([None if t is None else pack_text(t) for t in texts.to_pylist()], pa.binary())

    return packed_text(text)


def unpacked(data: Column) -> Column:
    """The texts again; null stays null."""

    @F.arrow_udf("string")
    def unpacked_text(rows):
        import pyarrow as pa

        return pa.array([None if r is None else unpack_text(r) for r in rows.to_pylist()], pa.string())

    return unpacked_text(data)
