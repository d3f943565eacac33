"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library does the merges. A long text is first cut at boundaries
that no match of the split pattern can span: between a character that is not
white space and a white-space character. Most pieces then hold no run of two
white-space characters, where the pattern's lookahead branch can never differ
from its plain ``\\s+`` branch; those pieces go through an encoding whose
pattern lacks the lookahead, which the regex engine matches faster.

Null text is the empty text (no ids). Special tokens are never produced and their
strings are ordinary text, unless a codec is given added tokens. Other columns of
the input pass through unchanged, but for columns called ``bpe_ids`` or
``bpe_bytes``, which are replaced. Repeated rows are encoded as often as they
occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

LOOKAHEAD = r"\s+(?!\S)|"
#: Pieces of long texts have at least this many characters.
PIECE_CHARS = 1 << 16
#: The characters with Unicode's White_Space property (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Python's \s holds all of White_Space and a few control characters more, which is the safe side for both uses.
_BOUNDARY = re.compile(rf"(?<=\S)[{WHITE_SPACE}]")
_DOUBLE = re.compile(r"\s\s")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """``(text, id)`` of the added tokens of a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that match other than by their plain text are not supported")
    return tuple((t["content"], t["id"]) for t in tokens)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE tokenizer's JSON file, checked for use as ranks.

    Ids are the ranks of merges only if the file lists single bytes first and then one
    token for each merge in order; another file is refused.
    """
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, before = data["model"], data["pre_tokenizer"]
    if model["type"] != "BPE" or data["normalizer"] or (before["type"], before["add_prefix_space"], before["use_regex"]) != ("ByteLevel", False, True):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    single = len(model["vocab"]) - len(model["merges"])
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if single != 256 or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        raise ValueError(f"{path} has ids that are not in the order of its merges")
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a rank file or of a tokenizer's JSON file."""
    return json_ranks(path) if path.endswith(".json") else read_ranks(path)


class Codec:
    """Encoder and decoder of one rank file, built once per Python worker.

    ``added`` are ``(text, id)`` of tokens that a text is cut at before all else,
    as the tokenizers library does.
    """

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        ranks = ranks_of(ranks_path)
        make = lambda p: tiktoken.Encoding("local", pat_str=p, mergeable_ranks=ranks, special_tokens={})
        self.full = make(pattern)
        self.plain = make(pattern.replace(LOOKAHEAD, "")) if LOOKAHEAD in pattern and pattern.endswith(r"|\s+") else self.full
        self.added = dict(added)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.tokens = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        for token, rank in added:
            self.tokens[rank] = token.encode()

    def ids(self, text: str | None) -> list[int]:
        if self.cut is None or not any(t in (text or "") for t in self.added):
            return self.ordinary(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else self.ordinary(part)
        return out

    def ordinary(self, text: str | None) -> list[int]:
        """Ids of a text in which the strings of added tokens mean nothing."""
        out: list[int] = []
        for piece in pieces(text or ""):
            out += (self.full if _DOUBLE.search(piece) else self.plain).encode_ordinary(piece)
        return out

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def pieces(text: str, at_least: int = PIECE_CHARS) -> list[str]:
    """Cut at safe boundaries into pieces of ``at_least`` characters or slightly more."""
    out, start = [], 0
    while len(text) - start > at_least:
        cut = _BOUNDARY.search(text, start + at_least)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:] if start else text)
    return out


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Codec:
    return Codec(ranks_path, pattern, added)


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def encode(text: Column, ranks_path: str, pattern: str | None = None) -> Column:
    """Binary column: the ids of each whole text as little-endian unsigned 32-bit integers."""
    pattern = pattern or default_pattern()

    @F.arrow_udf(BinaryType())
    def encode_ids(texts):
        import pyarrow as pa

        own = codec(ranks_path, pattern)
        return pa.array([pack_ids(own.ids(x)) for x in texts.to_pylist()], pa.binary())

    return encode_ids(text)


def decode(ids: Column, ranks_path: str, pattern: str | None = None) -> Column:
    """Binary column: the raw bytes that the ids stand for; null ids give no bytes."""
    pattern = pattern or default_pattern()

    @F.arrow_udf(BinaryType())
    def decode_ids(packed):
        import pyarrow as pa

        own = codec(ranks_path, pattern)
        return pa.array([own.bytes_of(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in packed.to_pylist()], pa.binary())

    return decode_ids(ids)


def encode_decode(df: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``bpe_ids`` (packed ids) and ``bpe_bytes`` (their decoded bytes)."""
    with_ids = df.withColumn("bpe_ids", encode(F.col(text_col), ranks_path))
    return with_ids.withColumn("bpe_bytes", decode(F.col("bpe_ids"), ranks_path))
