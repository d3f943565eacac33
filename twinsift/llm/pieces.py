"""SentencePiece encoding and decoding by a table of distinct chunks.

The library's normalizer turns a text into words behind white-space markers. A
chunk is a run of markers with what follows up to the next marker. If the model is
a BPE model without a piece in which a marker follows another character, without
user-defined pieces and with a normalizer that changes no characters, no merge
can cross from a chunk into the next one, so the ids of a text are those of its
chunks in order. Each task then segments every distinct chunk once with the
library, keeps its ids in a table, and joins the ids of a text back by the
positions of its chunks. A model without these properties is asked for whole
texts instead.

A table holds at most ``TABLE_BYTES`` and starts anew beyond; chunks of more than
``LONG_CHUNK`` characters are not kept. Texts are processed in slices of
about ``SLICE_CHARS`` characters, cut between chunks, so that the lists of a very long
text stay small; ids are decoded in slices likewise.

Null text is the empty text. A text without characters has the end id only, if one
is asked for. Strings of control pieces within texts are ordinary text. Other columns
pass through, but for columns called ``piece_ids`` or ``piece_text``, which are
replaced. Repeated rows are encoded as often as they occur; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_BYTES = 192 << 20
LONG_CHUNK = 200
SLICE_CHARS = 1 << 16
#: A table's entry takes about so many bytes besides its chunk and ids.
_ENTRY = 150
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
_BPE, _USER_DEFINED = 2, 4


class _Table(dict):
    """Packed ids of the chunks met so far."""

    def __init__(self, library):
        self.library, self.bytes, self.segmented = library, 0, 0
        # the library puts the first marker in front of a text itself, but not before nothing
        lone = library.encode(f"a{MARK}", num_threads=1)[len(library.encode("a", num_threads=1)) :]
        self.lone = np.array(lone, "<i4").tobytes()

    def join(self, chunks: list[str]) -> bytes:
        """Packed ids of ``chunks`` in order; those that the table lacks are segmented once each."""
        if self.bytes > TABLE_BYTES:
            self.clear()
            self.bytes = 0
        new = [c for c in set(chunks) if c not in self]
        self.segmented += len(new)
        for c, ids in zip(new, self.library.encode([c[1:] for c in new], num_threads=1) if new else (), strict=True):
            found = self[c] = np.array(ids, "<i4").tobytes() if c != MARK else self.lone
            self.bytes += _ENTRY + 4 * len(c) + len(found)
        out = b"".join(map(self.__getitem__, chunks))
        for c in new:
            if len(c) > LONG_CHUNK:
                self.bytes -= _ENTRY + 4 * len(c) + len(self.pop(c))
        return out


class Pieces:
    """A model with its table, built once per Python worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
        within = not any(_CUT.search(p.piece) or p.type == _USER_DEFINED for p in model.pieces)
        self.chunked = bool(plain and within and model.trainer_spec.model_type == _BPE)
        self.table = _Table(self.library)
        self.pieces = [p.piece for p in model.pieces]
        self.starts = np.array([p.startswith(MARK) for p in self.pieces])
        self.end_id = self.library.eos_id()

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, as the library's ``encode`` gives them."""
        if not text:
            return np.empty(0, np.int32)
        if not self.chunked:
            return np.array(self.library.encode(text, num_threads=1), np.int32)
        marked, out, start = MARK + text.replace(" ", MARK), [], 0
        while start < len(marked):
            cut = _CUT.search(marked, start + SLICE_CHARS) if len(marked) - start > SLICE_CHARS else None
            end = cut.start() if cut else len(marked)
            out.append(self.table.join(_CHUNK.findall(marked[start:end] if cut or start else marked)))
            start = end
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The library's ``decode`` of the ids, in slices that start with a marked piece."""
        out, start = [], 0
        while True:
            end = len(ids)
            if self.chunked and end - start > 2 * SLICE_CHARS:
                # a slice may begin with any marked piece but behind bytes, which could belong together
                marked = start + SLICE_CHARS + np.flatnonzero(self.starts[ids[start + SLICE_CHARS :]])
                end = int(marked[0]) if len(marked) else end
            # the library drops the marker in front of what it decodes
            out.append((" " if start else "") + self.library.decode(ids[start:end].tolist()))
            if end == len(ids):
                return "".join(out)
            start = end


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(text: Column, path: str, end_id: bool = True) -> Column:
    """Array column: the ids of each whole text, with the model's end id behind if ``end_id``."""

    @F.arrow_udf("array<int>")
    def encode_ids(texts):
        import pyarrow as pa

        own = pieces(path)
        last = np.array([own.end_id] if end_id else [], np.int32)
        found = [x for t in texts.to_pylist() for x in (own.ids(t), last)]
        sizes = np.array([len(x) for x in found], np.int64).reshape(-1, 2).sum(axis=1)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))

    return encode_ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text column: what the ids stand for; null ids give the empty text."""

    @F.arrow_udf("string")
    def decode_ids(rows):
        import pyarrow as pa

        own = pieces(path)
        return pa.array([own.decode(np.asarray(r.values.to_numpy(zero_copy_only=False), np.int32)) if r.is_valid else "" for r in rows], pa.string())

    return decode_ids(ids)


def encode_decode(df: DataFrame, path: str, text_col: str = "text", end_id: bool = True) -> DataFrame:
    """``df`` with ``piece_ids`` and ``piece_text``, the text that they decode to."""
    with_ids = df.withColumn("piece_ids", encode(F.col(text_col), path, end_id))
    return with_ids.withColumn("piece_text", decode(F.col("piece_ids"), path))
