"""Bit-level column expressions over 64-bit words kept as BIGINT patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED_FLIP = -(1 << 63)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit words (INT); sign plays no part."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def hamming_words(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two equally long arrays of words; null if their lengths differ."""
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def frame_distances(a: Column | str, b: Column | str) -> Column:
    """Array of the distances of corresponding words."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hex texts of any case; -1 for bad, odd or unequally long input."""
    a, b = _c(a), _c(b)
    good = a.rlike("^[0-9A-Fa-f]+$") & b.rlike("^[0-9A-Fa-f]+$") & (F.length(a) == F.length(b)) & (F.length(a) % 2 == 0)

    def word(x: Column, i: Column) -> Column:
        return F.conv(F.substring(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long")

    total = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.length(a) / 8).cast("int") - 1), F.lit(0), lambda s, i: s + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    )
    return F.when(F.coalesce(good, F.lit(False)), total).otherwise(F.lit(-1))


def segment_widths(bits: int, parts: int) -> list[int]:
    """Widths of ``parts`` contiguous segments of ``bits`` bits, wider ones first."""
    if not 1 <= parts <= bits:
        raise ValueError("between 1 and as many segments as bits")
    base, wide = divmod(bits, parts)
    return [base + 1] * wide + [base] * (parts - wide)


def segments(word: Column | str, parts: int, bits: int = 64) -> list[Column]:
    """Equal segments of the low ``bits`` bits of a word, most significant first, as BIGINT."""
    out, left = [], bits
    for width in segment_widths(bits, parts):
        left -= width
        shifted = F.shiftrightunsigned(_c(word), left) if left else _c(word)
        out.append(shifted.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else shifted)
    return out


def bit_string(words: Column | str) -> Column:
    """Words of an array as one text of 0 and 1, most significant bits first."""
    return F.array_join(F.transform(_c(words), lambda w: F.lpad(F.bin(w), 64, "0")), "")


def string_segments(bits: Column, total: int, parts: int) -> list[Column]:
    """Equal segments of a bit string; they may cross word borders."""
    out, at = [], 1
    for width in segment_widths(total, parts):
        out.append(F.substring(bits, at, width))
        at += width
    return out


def hex16(word: Column | str) -> Column:
    """Fixed-width lower-case hex of a word."""
    return F.lower(F.lpad(F.hex(_c(word)), 16, "0"))


def unsigned_key(word: Column | str) -> Column:
    """Sort key that orders BIGINT patterns as unsigned numbers."""
    return _c(word).bitwiseXOR(F.lit(UNSIGNED_FLIP))


def from_hex(text: Column | str) -> Column:
    """BIGINT pattern of a hex text of at most 16 digits."""
    return F.conv(_c(text), 16, -10).cast("long")
