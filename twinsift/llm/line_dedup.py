"""Line dedup by a deletion-neighbourhood join.

A line is compared in lower case with white space collapsed. It is dropped if an
earlier line (smaller id, then smaller line number; kept or not) is the same or is
near. Two lines are near if one word is inserted, deleted or replaced and the longer
one has at least ``Bound.words`` words (so that they share 0.8 of them by default), or if
one character is and the longer one has at least ``Bound.chars`` characters and the one
with fewer words has fewer than ``Bound.few`` words. So the bound on edits is a function of
the pair's lengths: none below both limits, one from there on. A line belongs to
both rules where both can apply. Lines of fewer than ``min_chars`` characters are never
dropped; the default of one leaves out blank lines only.

Plan
1. One pass over the texts gives per line a 128-bit digest and digests of its first
   and last units, words and characters. Equal lines are grouped on the digest; minima are combined
   before the shuffle, so a line that repeats everywhere is no hot spot. Only first
   occurrences go on.
2. Two lines within one edit share their first or their last few units (the edit
   lies in one half only). First occurrences whose halves nobody shares have no
   partner and are left out; this loses nothing. Of the rest, each line is cut
   into ``WINDOWS`` windows: lines within one edit share all units outside of one
   window. Windows whose outside nobody shares are left out as well.
3. The lines left emit their deletion variants: the line itself and the line less
   each one unit of the windows left, as hashed keys. Two lines within one edit
   share a variant: less the same position (replaced), or one is a variant of the
   other (inserted or deleted). So per variant the earliest whole line, the
   earliest line of each position and the earliest of all suffice; they are minima
   again, and joining them back gives each line a few candidates, never the pairs
   of a group. Keys are sums over prefixes and suffixes, so all variants of a line
   cost as much as the line is long.
4. Candidates are verified by the edit distance of the units.
5. The numbers of dropped lines go back to the documents.

Rows of a key that very many lines share are dealt into parts when they are joined
(``join_counted``). Null text stays null and has no lines. Rows with a null id stay
as they are. Repeated rows (the same id) are one document: each gets the same lines.
All other columns pass through (but for one called ``lines_dropped``, which is
replaced). A text keeps its line feeds between the lines that stay. An empty table
gives no rows.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.joins import join_counted
from twinsift.plans.storage import arrow_rows, free_name, materialize

MIN_CHARS = 1
WINDOWS = 8
#: Powers of a base that are kept.
KNOWN_POWERS = 65_536
#: Variants of a line are made and sent in slices of so many.
SLICE = 100_000
PLACE = ["doc_id", "pos"]
KEYS = [f"k{i}" for i in range(8)]
_LINES = f"doc_id long, pos int, hi long, lo long, {', '.join(f'{k} long' for k in KEYS)}"
_VARIANTS = "hi long, lo long, at int, doc_id long, pos int"
_WANTED = "doc_id long, pos int, line string"
_OUTSIDES = "k long, doc_id long, pos int, chars boolean, lo int, hi int"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def normal(line: str) -> str:
    """Lower case, white space collapsed."""
    return " ".join(line.lower().split())


class Bound(NamedTuple):
    """Lengths from which one edit is allowed."""

    words: int = 5
    chars: int = 10
    few: int = 10


def families(line: str, bound: Bound = Bound()) -> list[Sequence[str]]:
    """The units by which a normal line can have near lines: a list of its words, its characters as text, both or none.

    A near line may have one unit more or less, so a line one unit short of a limit is compared too.
    """
    return _families(line, line.split(" "), bound)


def _families(line: str, words: list[str], bound: Bound) -> list[Sequence[str]]:
    out: list[Sequence[str]] = [words] if len(words) >= bound.words - 1 else []
    return out + ([line] if len(line) >= bound.chars - 1 and len(words) <= bound.few else [])


def near(a: str, b: str, bound: Bound = Bound()) -> bool:
    """Whether two normal lines are within their bound."""
    x, y = a.split(" "), b.split(" ")
    if max(len(x), len(y)) >= bound.words and within_one(x, y):
        return True
    return max(len(a), len(b)) >= bound.chars and min(len(x), len(y)) < bound.few and within_one(a, b)


def _digest(part: Sequence[str], tag: str) -> int:
    kind = "c" if isinstance(part, str) else "w"
    h = xxhash.xxh3_64_intdigest(f"{kind}{tag}\x1f{part if kind == 'c' else ' '.join(part)}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _pair(text: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def half_keys(units: Sequence[str], bound: Bound = Bound()) -> list[int]:
    """Digests of the first and the last units, for the line's length class and, at its lower edge, for the class below.

    A class is as wide as the least length of near lines and takes half of its smallest
    length, so lines whose lengths differ by one always share a class; a line one unit short of
    the least length counts to the first class.
    """
    n, wide = len(units), bound.chars if isinstance(units, str) else bound.words
    classes = [max(n // wide, 1)] + ([n // wide - 1] if n % wide == 0 and n // wide > 1 else [])
    return [_digest(part, f"{side}{c}") for c in classes for size in (c * wide // 2,) for side, part in (("f", units[:size]), ("l", units[n - size :]))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_BASES[0])
    return x ^ (x >> np.uint64(29))


def _hashes(units: Sequence[str]) -> np.ndarray:
    if isinstance(units, str):
        return _mixed(np.frombuffer(units.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in units], np.uint64)


@functools.lru_cache(len(_BASES))
def _known_powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(KNOWN_POWERS - 1, base, np.uint64)]), dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``."""
    if n <= KNOWN_POWERS:
        return _known_powers(base)[:n]
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


@functools.cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Sums:
    """Polynomial hashes of a line's units, from which any part joined to any other costs one step."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = self.n = len(hashes)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(base, n), dtype=np.uint64, out=self.upto[1:])
        self.back = np.uint64(_inverse(base))

    def without(self, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the line less the units from ``lo`` to ``hi``; ``shift`` is the inverse base to the power of their number, one unit by default."""
        return self.upto[lo] + (self.upto[self.n] - self.upto[hi]) * (self.back if shift is None else shift)


@functools.lru_cache(4096)
def _windows(size: int, kind: int) -> tuple[np.ndarray, ...]:
    """What ``window_keys`` needs of a line's length only: ``lo``, ``hi``, the shifts and the tags of its keys."""
    cuts = np.arange(WINDOWS + 1)
    lo = np.concatenate([n * cuts[:-1] // WINDOWS for n in (size, size - 1)])
    hi = np.concatenate([size - (n - n * cuts[1:] // WINDOWS) for n in (size, size - 1)])
    shift = np.array([pow(_inverse(_BASES[0]), d, 1 << 64) for d in (hi - lo).tolist()], np.uint64)
    tags = np.array([(n * WINDOWS + j) * 2 + kind for n in (size, size - 1) for j in range(WINDOWS)], np.uint64)
    return lo, hi, shift, _mixed(tags + np.uint64(1))


def _window_columns(units: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, hi, shift, tags = _windows(len(units), int(isinstance(units, str)))
    return _mixed(Sums(_hashes(units), _BASES[0]).without(lo, hi, shift) + tags).view(np.int64), lo, hi


def window_keys(units: Sequence[str]) -> list[tuple[int, int, int]]:
    """``(key, lo, hi)``: per window a hash of all units outside of ``units[lo:hi]``, for the line's length and the length below.

    For the length below, a line has one unit more in each window; so a line and
    one with a unit inserted share the key of the window that holds it.
    """
    return list(zip(*(c.tolist() for c in _window_columns(units)), strict=True))


def variants(units: Sequence[str], places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``hi``, ``lo`` and position of the line itself (position -1) and of the line less the unit at each of ``places``, in slices."""
    kind = np.uint64(isinstance(units, str)) * np.uint64(_BASES[1])
    hashes = _hashes(units)
    sums = [Sums(hashes, base) for base in _BASES]
    hi, lo = (_mixed(own.upto[own.n :] + kind).view(np.int64) for own in sums)
    yield hi, lo, np.array([-1], np.int32)
    for at in range(0, len(places), SLICE):
        some = places[at : at + SLICE]
        hi, lo = (_mixed(own.without(some, some + 1) + kind).view(np.int64) for own in sums)
        yield hi, lo, some.astype(np.int32)


def within_one(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether the edit distance in units is at most one: all units after the first difference must agree."""
    if type(a) is not type(b) or abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :]
    return a[at + 1 :] == b[at:] if len(a) > len(b) else a[at:] == b[at + 1 :]


def _lines(min_chars: int, bound: Bound):
    def lines(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            # plain 64-bit numbers, row by row: a batch of very long texts holds hundreds of thousands of lines
            out, known, none = array("q"), array("b"), (0,) * len(KEYS)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pos, line in enumerate(text.split("\n")):
                    words = line.lower().split()
                    whole = " ".join(words)
                    if len(whole) < max(min_chars, 1):
                        continue
                    keys = [k for units in _families(whole, words, bound) for k in half_keys(units, bound)]
                    out.extend((doc, pos, *_pair(whole), *keys, *none[len(keys) :]))
                    known.append(len(keys))
            columns = np.frombuffer(out, np.int64).reshape(-1, 4 + len(KEYS)).T
            masks = [None] * 4 + list(np.arange(len(KEYS))[:, None] >= np.frombuffer(known, np.int8))
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * (2 + len(KEYS)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k, mask=m) for c, k, m in zip(columns, kinds, masks, strict=True)], ["doc_id", "pos", "hi", "lo", *KEYS])

    return lines


def _wanted_lines(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        docs, places, found = [], [], []
        for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lines = text.split("\n")
            own = [p for p in set(wanted) if p < len(lines)]
            docs += [doc] * len(own)
            places += own
            found += [normal(lines[p]) for p in own]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(found, pa.string())], ["doc_id", "pos", "line"])


def _outsides(bound: Bound):
    def outsides(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out, docs, places, chars = [], [], [], []
            for doc, pos, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for units in families(line, bound):
                    out.append(_window_columns(units))
                    docs.append(doc)
                    places.append(pos)
                    chars.append(isinstance(units, str))
            # a line has as many keys as another
            whole = lambda values, kind: np.repeat(np.array(values, kind), 2 * WINDOWS)
            k, lo, hi = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
            columns = (k, whole(docs, np.int64), whole(places, np.int32), whole(chars, np.bool_), lo, hi)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if t == pa.int32() else c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "doc_id", "pos", "chars", "lo", "hi"])

    return outsides


def _variants(bound: Bound):
    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, size = [], 0

        def batch_of():
            columns = [np.concatenate([x[i] for x in out]) if out else [] for i in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["hi", "lo", "at", "doc_id", "pos"])

        for batch in batches:
            for doc, pos, line, windows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for units in families(line, bound):
                    own = [np.arange(w["lo"], w["hi"]) for w in windows if w["chars"] == isinstance(units, str)]
                    for hi, lo, at in variants(units, np.unique(np.concatenate(own))) if own else ():
                        out.append((hi, lo, at, np.full(len(hi), doc, np.int64), np.full(len(hi), pos, np.int32)))
                        size += len(hi)
                        if size >= SLICE:
                            yield batch_of()
                            out, size = [], 0
        yield batch_of()

    return emit


def duplicate_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, bound: Bound = Bound()) -> DataFrame:
    """``(doc_id, pos, distance)`` of every line to drop: 0 for equal lines, 1 for lines one edit from an earlier one."""
    arrow_rows(df.sparkSession, 500)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = materialize(docs.mapInArrow(_lines(min_chars, bound), _LINES), "lines")
    place = F.struct("doc_id", "pos")
    firsts = lines.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n"), *[F.max(k).alias(k) for k in KEYS])
    firsts = materialize(firsts, "firsts")
    repeated = firsts.where("n > 1").select("hi", "lo", "first", "n")
    same = join_counted(lines.select("doc_id", "pos", "hi", "lo"), repeated, ["hi", "lo"], PLACE).where(place != F.col("first")).select("doc_id", "pos", F.lit(0).alias("distance"))

    def shared(rows: DataFrame, on: list[str], *more) -> DataFrame:
        """Keys that several rows have, counted."""
        return materialize(rows.groupBy(*on).agg(F.count("*").alias("n"), *more).where("n > 1"), "shared")

    halves = firsts.where("k0 IS NOT NULL").select(F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"), F.explode(F.filter(F.array(*KEYS), lambda k: k.isNotNull())).alias("k"))
    wanted = join_counted(halves, shared(halves, ["k"]), ["k"], PLACE).groupBy("doc_id").agg(F.collect_set("pos").alias("wanted"))  # of one document's lines
    # sort-merge at every size: the lines wanted grow with the input
    texts = docs.join(wanted.hint("merge"), "doc_id")
    shown = materialize(texts.select("doc_id", "text", "wanted").mapInArrow(_wanted_lines, _WANTED).distinct(), "near")

    outsides = materialize(shown.mapInArrow(_outsides(bound), _OUTSIDES), "outsides")
    open_windows = join_counted(outsides, shared(outsides, ["k"]), ["k"], PLACE).groupBy("doc_id", "pos").agg(F.collect_set(F.struct("chars", "lo", "hi")).alias("windows"))  # of one line
    emitted = materialize(shown.join(open_windows.hint("merge"), ["doc_id", "pos"]).select("doc_id", "pos", "line", "windows").mapInArrow(_variants(bound), _VARIANTS), "variants")
    first_of = lambda which: F.min(F.when(which, place))
    by_variant = shared(emitted, ["hi", "lo"], first_of(F.col("at") < 0).alias("whole"), first_of(F.col("at") >= 0).alias("less"))
    across = join_counted(emitted, by_variant, ["hi", "lo"], PLACE).select("doc_id", "pos", F.when(F.col("at") < 0, F.col("less")).otherwise(F.col("whole")).alias("other"))
    by_place = shared(emitted.where("at >= 0"), ["hi", "lo", "at"], F.min(place).alias("other"))
    replaced = join_counted(emitted, by_place, ["hi", "lo", "at"], PLACE).select("doc_id", "pos", "other")
    candidates = across.unionByName(replaced).where(F.col("other") < place).select("doc_id", "pos", F.col("other.doc_id").alias("o_doc"), F.col("other.pos").alias("o_pos")).distinct()
    others = materialize(candidates.groupBy("o_doc", "o_pos").agg(F.count("*").alias("n")), "others")
    earlier = others.join(shown.select(F.col("doc_id").alias("o_doc"), F.col("pos").alias("o_pos"), F.col("line").alias("o_line")).hint("merge"), ["o_doc", "o_pos"])
    paired = candidates.join(shown, ["doc_id", "pos"])
    paired = join_counted(paired, materialize(earlier, "earlier"), ["o_doc", "o_pos"], PLACE)

    @F.arrow_udf("boolean")
    def within(a, b):
        import pyarrow as pa

        return pa.array([near(x, y, bound) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    edited = paired.where(within("line", "o_line")).select("doc_id", "pos").distinct()
    # near lines are first occurrences: their later copies are in ``same`` already
    return same.unionByName(edited.withColumn("distance", F.lit(1)))


def drop_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, bound: Bound = Bound()) -> DataFrame:
    """``df`` with the dropped lines cut out of the text, and ``lines_dropped``, their number."""
    place, lines = free_name(df, "gone_doc"), free_name(df, "gone_lines")
    gone = duplicate_lines(df, text_col, id_col, min_chars, bound).groupBy(F.col("doc_id").alias(place)).agg(F.collect_set("pos").alias(lines))  # of one document's lines
    joined = df.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(place), "left")

    @F.arrow_udf("string")
    def cut(texts, gone):
        import pyarrow as pa

        out = []
        for text, drop in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            if text is not None and drop:
                drop = set(drop)
                text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in drop])
            out.append(text)
        return pa.array(out, pa.string())

    kept = joined.withColumn(text_col, cut(F.col(text_col), F.col(lines))).withColumn("lines_dropped", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    return kept.select(*[c for c in df.columns if c != "lines_dropped"], "lines_dropped")
